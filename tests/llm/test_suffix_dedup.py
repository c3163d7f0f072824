"""Suffix order and removal of repeated bytes against plain versions."""

import random

import numpy as np
import pytest

from factspan.llm import suffix_dedup
from factspan.llm.suffix_array import common_prefixes, eight_bytes, suffix_order

SPAN = 400


@pytest.mark.parametrize("seed", range(12))
def test_suffix_order(seed):
    draw = random.Random(seed)
    letters = [b"a", b"ab", b"\0\1", bytes(range(256)), b"abc \xff"][seed % 5]
    text = b"".join(bytes([draw.choice(letters)]) * draw.choice([1, 1, 1, 40]) for _ in range(draw.randrange(1, 120)))
    text += text[draw.randrange(len(text)) :]
    data, n = np.frombuffer(text, np.uint8), len(text)
    keys = eight_bytes(data, n + 8)
    for wanted in (np.ones(n, bool), np.array([draw.random() < 0.4 for _ in range(n)])):
        # Zero bytes at the very end are told from nothing only by the caller, who asks for whole spans.
        order = suffix_order(data, wanted, n + 8, keys).tolist()
        pad = lambda i: text[i:] + b"\0" * i
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        assert [pad(i) for i in order] == sorted(map(pad, order))
        prefixes = common_prefixes(np.array(order, np.int64), keys, 16)
        for a, b, got in zip(order, order[1:], prefixes[1:].tolist()):
            assert got == next((d for d in range(16) if pad(a)[d : d + 1] != pad(b)[d : d + 1]), 16) or max(a, b) + 16 > n


def plain(rows):
    starts: dict = {}
    for r, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for s in range(len(data) - SPAN + 1):
            starts.setdefault(data[s : s + SPAN], []).append((r, s))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for where in starts.values():
        if len(where) > 1:
            for r, s in where:
                gone[r][s : s + SPAN] = True
    out = []
    for (i, text), g in zip(rows, gone):
        data = np.frombuffer((text or "").encode(), np.uint8)
        spans = int((g & ~np.r_[False, g[:-1]]).sum()) if len(g) else 0
        out.append((i, len(data), int(g.sum()), spans, data[~g].tobytes()))
    return sorted(out, key=str)


def letters(n, seed):
    draw = random.Random(seed)
    return "".join(draw.choice("abcdefgh éß\n") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage, short = letters(900, 1), letters(380, 2)
    rows = [(i, letters(50 + 37 * i, 10 + i) + passage + letters(300, 50 + i)) for i in range(8)]
    # A passage just too short on its own, in many texts: pieces around one anchor, all unlike.
    rows += [(20 + i, letters(60, 100 + i) + short + letters(90, 200 + i)) for i in range(60)]
    rows += [(100, letters(399, 5)), (101, letters(399, 5)), (102, letters(400, 6)), (103, letters(400, 6)), (104, None), (105, ""), (106, "a" * 1500), (107, "a" * 400)]
    rows += [(108, "line of text\n" * 90), (109, letters(60_000, 7) + passage[200:] + letters(700, 8) * 2), (None, letters(500, 9)), (None, letters(500, 9)), (None, "other")]
    rows += [rows[0], (110, letters(800, 11)), (110, letters(800, 11)), (110, letters(700, 12)), (111, letters(250, 13)), (112, letters(250, 13) + letters(450, 14)[200:])]
    return rows


@pytest.mark.parametrize("crowded,bucket", [(2 << 20, 4 << 20), (3000, 5000)])
def test_deduplicate(spark, rows, monkeypatch, crowded, bucket):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, n long").repartition(3)
    got = suffix_dedup.deduplicate(table).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == plain(rows)


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    passage = letters(1000, 1)
    long = [(1, letters(5000, 2) + passage + letters(3000, 3) + passage[100:]), (2, letters(100, 4) + passage[:600])]
    parts = [suffix_dedup._anchored(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t in long]
    assert sum(int((last - first + 1).sum()) for _, first, last, _ in parts) == sum(len(t.encode()) - SPAN + 1 for _, t in long)
    table = spark.createDataFrame(long, "doc_id long, text string")
    got = suffix_dedup.deduplicate(table).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == plain(long)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert suffix_dedup.deduplicate(none).count() == 0
    one = spark.createDataFrame([("a", None), ("b", "few")], none.schema)
    assert sorted((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.deduplicate(one).collect()) == [("a", 0, b""), ("b", 3, b"few")]
