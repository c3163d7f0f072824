"""Long words that are unlike in every letter, yet alike to any sum of letter codes times powers modulo 2^64."""

from factspan.llm import decontaminate, ngram_join, substrings

FIRST = "".join("ab"[i.bit_count() & 1] for i in range(1024))
SECOND = FIRST.translate(str.maketrans("ab", "ba"))


def texts(spark, n):
    rest = " ".join(f"word{i}" for i in range(n))
    return spark.createDataFrame([(1, f"{FIRST} {rest}"), (2, f"{SECOND} {rest}")], "doc_id long, text string")


def test_near_duplicates(spark):
    table = spark.createDataFrame([(1, FIRST), (2, SECOND)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(table).collect()} == {1: 1, 2: 2}


def test_decontamination(spark):
    item = spark.createDataFrame([(7, FIRST)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(texts(spark, 3), item).collect()} == {1: 1, 2: 0}
    item = spark.createDataFrame([(7, f"{FIRST} " + " ".join(f"word{i}" for i in range(9)))], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(texts(spark, 9), item).collect()} == {1: 10, 2: 0}


def test_substrings(spark):
    assert {r["doc_id"]: r["n_removed"] for r in substrings.deduplicate(texts(spark, 49)).collect()} == {1: 0, 2: 0}
    assert {r["doc_id"]: r["n_removed"] for r in substrings.deduplicate(texts(spark, 50)).collect()} == {1: 0, 2: 50}
