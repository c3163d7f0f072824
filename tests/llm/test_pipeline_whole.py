"""Near-duplicate groups without an id of their own, and the whole pipeline, against brute force."""

import collections
import random
import re
import zlib

import numpy as np

from factspan.llm import ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}x" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """Rows (doc_id, text) grouped by chains of links; a row without words is a group of its own."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [root[b] if r == root[a] else r for r in root]
    found = collections.defaultdict(list)
    for row, r in zip(rows, root):
        found[r].append(row)
    return list(found.values())


def odd_rows():
    """Null ids with unlike texts, with copies and with empty texts; one id with two unlike texts, one of them linked; repeats."""
    base = words(60, 1)
    near = base[:]
    near[0] = "changed"
    rows = [(None, " ".join(words(50, 10 + i))) for i in range(6)]
    rows += [(None, rows[0][1]), (None, " ".join(base)), (3001, " ".join(near)), (None, ""), (None, None), (3002, ""), (3002, "")]
    rows += [(3003, " ".join(words(50, 30))), (3003, " ".join(words(50, 31))), (3004, " ".join(words(50, 31))), (3003, " ".join(words(50, 30)))]
    return rows


def kept_of(rows):
    """What stays of the rows; texts of a group's least id are equal in these tables."""
    out = []
    for group in groups(rows):
        ids = [i for i, _ in group if i is not None]
        least = min(ids) if ids else None
        if not shingles(group[0][1]):
            out += group
        else:
            (text,) = {t for i, t in group if i == least}
            out.append((least, text))
    return out


def test_groups_are_told_apart_by_links_not_ids(spark):
    rows = odd_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(table).collect())
    assert got == collections.Counter(kept_of(rows))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    draw, passage = random.Random(4), words(30, 77, 10_000)
    rows, labels = odd_rows(), []
    for i in range(400):
        w, toxic = words(60, 1000 + i), i % 8 == 0
        if toxic:
            w[draw.randrange(60)] = "vile"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000 + i, " ".join(words(20, 5000 + i) + passage[i : i + 8 + i] + words(20, 6000 + i))) for i in range(5)]
    rows += [(2100 + i, " ".join([*words(30, 7000 + i), 'password = "abcdefgh12"', *words(30, 8000 + i)])) for i in range(3)]
    rows += [(2200, " ".join(words(3000, 9000)))]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    windows = {tuple(passage[s : s + 10]) for s in range(21)}
    hit = lambda w: any(tuple(w[s : s + 10]) in windows for s in range(len(w) - 9))
    stay = kept_of([(i, t) for i, t in rows if "vile" not in (t or "")])
    stay = [(i, t) for i, t in stay if not hit((t or "").split())]
    stay = [(i, re.sub('password = "abcdefgh12', "[SECRET]", t or "")) for i, t in stay]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, text in stay:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for n, length in enumerate([len(ids) % 2048 or 2048, *[2048] * ((len(ids) - 1) // 2048)]):
            want[i, n, at, length, zlib.crc32(ids[at : at + length].tobytes())] += 1
            at += length
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        ends = np.cumsum([length for _, length in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
