"""Very long runs of blanks in a text, and texts that repeat themselves."""

from factspan.llm import packing, substrings


def test_long_runs_of_blanks_give_the_tokens_of_the_json_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    blanks, mixed = " " * 1_500_000, " \n\t " * 300_000
    texts = [f"one{blanks}two  three", f"{blanks}'s", blanks, f"a\n{mixed}\n7<|endoftext|>{mixed}<|endoftext|> {mixed}b", "\x1c" * 200_000 + "\n" * 1_000_000 + "é"]
    wanted = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert all(encode(text) == want for text, want in zip(texts, wanted))
    table = spark.createDataFrame(list(enumerate(texts[:2])), "doc_id long, text string")
    lengths = {r["doc_id"]: r["n"] for r in packing.pack(table).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert lengths == {i: len(wanted[i]) + 1 for i in range(2)}


def test_periodic_texts_lose_their_repeated_windows(spark):
    """Words that repeat every two, three and sixty words, so that anchors do too; documents differ only far behind."""
    def cycle(n, length, tail):
        return " ".join([f"p{i % n}" for i in range(length)] + tail)

    rows = [(i, cycle(n, length, [f"end{i}"] * 3)) for i, (n, length) in enumerate([(2, 300), (2, 301), (2, 120), (3, 200), (1, 90), (1, 400), (60, 500), (60, 559), (2, 49)])]
    seen, want = {}, {}
    for i, text in rows:
        w = text.split()
        gone = set()
        for s in range(len(w) - 49):
            if seen.setdefault(tuple(w[s : s + 50]), i) < i:
                gone |= set(range(s, s + 50))
        want[i] = len(gone)
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == want
