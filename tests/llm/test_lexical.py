"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from factspan.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    return [t.translate(LOWER) for t in TERMS.findall(text or "")]


def plain(items, docs, best):
    counts = [(i, Counter(cut(t))) for i, t in docs]
    N, L = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(cut(text))
    rows = []
    for item, terms in wanted.items():
        scored = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * N) // max(L, 1)
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:best], 1)]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(8)
    # Words of every frequency: from one in every text down to one in a single text.
    word = lambda: f"W{int(3000 * draw.random() ** 4)}é"
    docs = [(i, " ".join(word() for _ in range(draw.randrange(1, 120)))) for i in range(700)]
    docs += [(1000 + i, "the copied text with W3é W900é in it " * 3) for i in range(300)]
    docs += [(2000, None), (2001, ""), (2002, "!?"), (2003, " ".join(word() for _ in range(20_000))), docs[5], docs[5], (None, docs[6][1]), (None, "other words"), (2004, docs[6][1]), (2005, "y" * 70_000)]
    items = [(i, " ".join(word() for _ in range(draw.randrange(3, 30)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "unheardof"), (103, "W3é W3é w900É copied"), (None, "other W1é"), (104, "W1é"), (104, "W2é other"), (105, "y" * 70_000)]
    return items, docs


@pytest.mark.parametrize("block,bundle", [(8192, 256), (60, 7)])
def test_search(spark, tables, monkeypatch, block, bundle):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "BUNDLE_ITEMS", bundle)
    items, docs = tables
    left = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id long, text string, score int, ids string").repartition(2)
    right = spark.createDataFrame([(i, t, 2, "s") for i, t in docs], "doc_id long, text string, rank int, block string").repartition(3)
    for best in (50, 5):
        got = lexical.search(left, right, best)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(items, docs, best)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id string, item_id string, text string")
    one = spark.createDataFrame([("a", "q", "few words")], none.schema)
    assert lexical.search(none, one).count() == lexical.search(one, none).count() == lexical.search(none, none).count() == 0
    assert [tuple(r) for r in lexical.search(one, one).select("item_id", "doc_id").collect()] == [("q", "a")]


def test_a_block_is_put_in_order_in_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n, docs = np.random.default_rng(5), 100_000, 400
    found = [(np.sort(rng.integers(0, docs, n).astype(np.int32)), *rng.integers(0, 900, (2, n)).astype(np.uint64), np.ones(n, np.int32)) for _ in range(10)]
    ids, sizes = [pa.array(range(docs))], [np.full(docs, 10 * n // docs)]
    tracemalloc.start()
    rows = lexical.block_rows(7, ids, sizes, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not found and sum(len(x) for x in rows["docs"].to_pylist() if x) == 10 * n
    # Before, the pieces, their joined copies and the ordered copies lay side by side: some 100 bytes a posting.
    assert peak < 75 * 10 * n
    # A worker's share of an executor is some 300 MB, of which Python and its libraries take half.
    assert lexical.BLOCK_POSTINGS * 100 <= 128 << 20
