"""Importance resampling against zlib and a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factspan.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 5000, 70_001])
def test_crc_of_any_substring_from_two_prefixes(size):
    draw = np.random.default_rng(size)
    data = draw.integers(0, 256, size, dtype=np.uint8)
    prefix = resampling.prefix_registers(data)
    start = draw.integers(0, size + 1, 200)
    end = start + draw.integers(0, size + 1, 200) % (size + 1 - start)
    got = resampling.substring_crc(prefix, start, end)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


def plain(docs, target, most, buckets, percent, least):
    def runs(text):
        w = WORDS.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(text)[1])
    for text in target:
        t.update(runs(text)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        n, found = runs(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {id(r): k for k, r in enumerate(fit[: len(fit) * percent // 100], 1)}
    return sorted(((*r, place.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling(spark, most):
    draw = random.Random(4)
    text = lambda n, v: " ".join(f"Wö{draw.randrange(v)}" for _ in range(n))
    docs = [(i, text(draw.randrange(60), 90)) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " -- "), (203, text(30_000, 5000)), (204, "x" * 100_000), docs[3], docs[3], (205, "one.TWO-one two"), (None, text(40, 90)), (None, text(40, 90))]
    docs += [(300 + i, "same words again " * 8) for i in range(40)]
    target = [text(20, 40), None, "", "One two"]
    table = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(5)
    wanted = spark.createDataFrame([(t, 3) for t in target], "text string, weight int")
    got = resampling.resample(table, wanted, most, buckets=500, percent=30)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, most, 500, 30, 20)


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    one = spark.createDataFrame([("a", "few words"), ("b", None)], none.schema)
    assert resampling.resample(none, one).count() == 0
    got = resampling.resample(one, none)
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got.collect()} == {("a", 3, None), ("b", 0, None)}
