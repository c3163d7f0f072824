"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of 64 words. Every passage is encoded by what its bytes and words look like (shares of kinds of
characters, word lengths, repetition, hashed byte pairs); a hidden layer and gated attention, tanh times sigmoid, learn from the labels of whole
texts which passages count, and the weighted passage representation is scored. Every passage of every text is read.

The model is fitted on a bounded sample of the labelled rows. Null texts and texts without words have no passage: score 0. With
fewer than two labels in the sample every other text gets the base rate. Repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_type, settle, spread
from .words import NON_BLANK, text_groups, words_of

PASSAGE = 64
PAIRS = 16
#: Labelled rows that train, for each label at most: those of least hashed id.
SAMPLE_PER_LABEL = 1500
HIDDEN, GATE = 24, 12
STEPS = 250
RATE = 0.02
DECAY = 1e-4

_KIND = np.full(256, 5, np.int64)  # 5: other ASCII
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 3, 4
_KINDS = 6
WIDTH = _KINDS + 6 + PAIRS


def encode(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and features of every passage of a group of texts."""
    words = words_of(buf, offsets, NON_BLANK, lower=False)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros((0, WIDTH))
    owner = words.text_of_word()
    inside = np.arange(len(owner)) - words.first[owner]
    head = np.flatnonzero(inside % PASSAGE == 0)
    sizes = np.diff(np.r_[head, len(owner)])
    passage = np.repeat(np.arange(len(head)), sizes)
    begin, end = words.start[head], words.end[head + sizes - 1]
    length = (end - begin).astype(float)
    shares = []
    kind = _KIND[buf]
    for k in range(_KINDS):
        sums = np.r_[0, np.cumsum(kind == k, dtype=np.int64)]
        shares.append((sums[end] - sums[begin]) / length)
    mean = lambda x: np.bincount(passage, x, minlength=len(head)) / sizes
    long = (words.end - words.start).astype(float)
    average = mean(long)
    order = np.lexsort((words.hash, passage))
    sorted_hash, sorted_passage = words.hash[order], passage[order]
    fresh = np.r_[True, (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_passage[1:] != sorted_passage[:-1])]
    distinct = np.bincount(sorted_passage[fresh], minlength=len(head)) / sizes
    again = np.r_[False, (words.hash[1:] == words.hash[:-1]) & (passage[1:] == passage[:-1])]
    last = kind[words.end - 1]
    shape = [average, np.sqrt(np.maximum(0, mean(long**2) - average**2)), distinct, mean(again), mean(last == 5), np.log1p(sizes)]
    # Byte pairs of the passages, hashed.
    at = np.zeros(len(buf) + 1, np.int64)
    np.add.at(at, begin, 1)
    of = np.cumsum(at[:-1]) - 1
    pair = (buf[:-1].astype(np.int64) * 31 + buf[1:]) * 2654435761 % (1 << 32) >> 16
    where = of[:-1] * PAIRS + pair % PAIRS
    valid = of[:-1] >= 0
    pairs = np.bincount(where[valid], minlength=len(head) * PAIRS).reshape(len(head), PAIRS) / length[:, None]
    return owner[head], np.column_stack([*shares, *shape, pairs])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    base: float

    def score(self, bag: np.ndarray, x: np.ndarray, bags: int) -> np.ndarray:
        """Probability of label 1 of each bag; ``bag`` rises."""
        if not self.weights:
            return np.where(np.bincount(bag, minlength=bags) > 0, self.base, 0.0)
        out = _forward((x - self.mean) / self.scale, bag, bags, self.weights)[-1]
        return np.where(np.bincount(bag, minlength=bags) > 0, 1 / (1 + np.exp(-np.clip(out, -30, 30))), 0.0)


def _bag_sum(bag: np.ndarray, x: np.ndarray, bags: int) -> np.ndarray:
    out = np.zeros((bags, *x.shape[1:]))
    if len(bag):
        starts = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        out[bag[starts]] = np.add.reduceat(x, starts)
    return out


def _forward(x, bag, bags, p):
    h = np.tanh(x @ p["w"] + p["b"])
    one, two = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    gate = one * two
    e = gate @ p["a"]
    top = np.full(bags, -np.inf)
    np.maximum.at(top, bag, e)
    weight = np.exp(e - top[bag])
    weight /= np.maximum(_bag_sum(bag, weight, bags), 1e-300)[bag]
    z = _bag_sum(bag, weight[:, None] * h, bags)
    return h, one, two, gate, weight, z, z @ p["c"] + p["d"][0]


def train(bag: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on passages ``x`` of bags with labels ``y``: the whole gradient, Adam steps, a fixed seed."""
    rate = float(y.mean()) if len(y) else 0.5
    if not len(x) or rate in (0.0, 1.0):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, rate)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x, bags = (x - mean) / scale, len(y)
    rng = np.random.default_rng(7)
    draw = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
    p = {"w": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.log([rate / (1 - rate)])}
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, STEPS + 1):
        h, one, two, gate, weight, z, out = _forward(x, bag, bags, p)
        error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / bags
        dz = error[:, None] * p["c"]
        pull = (dz[bag] * h).sum(1)
        de = weight * (pull - _bag_sum(bag, weight * pull, bags)[bag])
        dgate = de[:, None] * p["a"]
        d1, d2 = dgate * two * (1 - one**2), dgate * one * two * (1 - two)
        dh = weight[:, None] * dz[bag] + d1 @ p["v"].T + d2 @ p["u"].T
        dh *= 1 - h**2
        slopes = {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ d1, "u": h.T @ d2, "a": gate.T @ de, "c": z.T @ error, "d": np.array([error.sum()])}
        for k, g in slopes.items():
            g = g + DECAY * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p, rate)


def _sampled(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).na.drop().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = marked.withColumn("place", spread(F.lit("quality"), F.col("doc_id").cast("string")))
    shares = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    total = sum(shares.get(label, 0) for label in (0, 1))
    if not total:
        return np.zeros(0, np.int64), np.zeros((0, WIDTH)), np.zeros(0)
    # Both labels in their proportions, so that scores are probabilities.
    most = min(2 * rows, total)
    parts = [marked.filter(F.col("quality") == label).orderBy("place", "doc_id").limit(-(-shares.get(label, 0) * most // total)) for label in (0, 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("place", "quality", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _hi, buf, offsets in text_groups(batch.column(2)):
                owner, x = encode(buf, offsets)
                rows = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(owner + lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float32)), WIDTH).cast(pa.list_(pa.float32()))],
                    names=["place", "quality", "row", "x"],
                )

    found = texts.mapInArrow(read, "place long, quality int, row long, x array<float>").toArrow()
    place, row = found["place"].to_numpy(), found["row"].to_numpy()
    _, bag = np.unique(place, return_inverse=True)
    order = np.lexsort((row, bag))
    x = np.array(found["x"].combine_chunks().values.to_numpy(), float).reshape(-1, WIDTH)[order] if len(found) else np.zeros((0, WIDTH))
    y = np.zeros(bag.max() + 1 if len(bag) else 0)
    y[bag] = found["quality"].to_numpy()
    return bag[order], x, y


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_PER_LABEL) -> Model:
    """The model of the labels given."""
    settle(docs.sparkSession)
    return train(*_sampled(docs, labels, rows))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, one row per row of ``docs``."""
    settle(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sent.value.score(*encode(buf, offsets), hi - lo))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {id_type(docs)}, score double")
