"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model reads a text's distinct words in hashed columns and the log odds of all
earlier categories. In training these come from models that did not see the row (out-of-fold predictions), so that a later
model learns how far it can trust them; in scoring they come from the earlier models themselves. A category's threshold is
the one with the best F1 on its out-of-fold predictions.

Models are fitted on a bounded sample of the labelled rows, all of which are scanned; every text is scored whole. Null and
empty texts have no words and get the score of the bias alone, and are never flagged. A category without both labels in the sample predicts
its base rate and flags nothing. Labels of a repeated id: the greater one. Repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import id_type, settle, spread
from .words import LETTERS_DIGITS, U, text_groups, words_of

COLUMNS = 1 << 20
#: Labelled rows that train: for each label of the last category at most this many, those of least hashed id.
SAMPLE_PER_LABEL = 3000
FOLDS = 3
#: A column is learned if that many sampled texts hold it.
LEAST_TEXTS = 3
STEPS = 150
RATE = 0.08
DECAY = 1e-3


@dataclass
class Link:
    """One category's model: columns that are not learned weigh nothing."""

    name: str
    weights: np.ndarray
    bias: float
    earlier: np.ndarray
    threshold: float


def _distinct_columns(batch: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi; text and hashed column of their distinct words, by text."""
    for lo, hi, buf, offsets in text_groups(batch):
        words = words_of(buf, offsets, LETTERS_DIGITS, lower=True)
        keys = np.unique(words.text_of_word() * COLUMNS + (words.hash >> U(40)).astype(np.int64) % COLUMNS)
        yield lo, hi, keys // COLUMNS, keys % COLUMNS


def sampled(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(labels by row and category, distinct columns of each row, labelled rows that each row stands for) of the bounded training sample."""
    names = list(categories)
    marked = labels.select("doc_id", *[c.cast("int").alias(n) for n, c in categories.items()]).groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    marked = marked.filter(F.col("doc_id").isNotNull()).na.drop(subset=names).withColumn("place", spread(F.lit("toxicity"), F.col("doc_id").cast("string")))
    parts = [marked.filter(F.col(names[-1]) == label).orderBy("place", "doc_id").limit(rows) for label in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    # Of an id with several texts the sample takes each.
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("place", "text", *names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, owner, column in _distinct_columns(batch.column(1)):
                ends = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(column.astype(np.int32)))
                rest = [batch.column(i).slice(lo, hi - lo) for i in range(2, 2 + len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, *rest], names=["place", "columns", *names])

    found = texts.mapInArrow(read, "place long, columns array<int>, " + ", ".join(f"{n} int" for n in names)).toArrow().sort_by("place")
    y = np.array([found[n].to_numpy() for n in names], float).reshape(len(names), -1).T
    all_rows = {r[names[-1]]: r["count"] for r in marked.groupBy(names[-1]).count().collect()}
    last = y[:, -1] if len(y) else np.zeros(0)
    stands_for = np.where(last == 1, all_rows.get(1, 0) / max(1, last.sum()), all_rows.get(0, 0) / max(1, (1 - last).sum()))
    return y, [np.asarray(c.values.to_numpy()) if len(c) else np.zeros(0, np.int32) for c in found["columns"]], stands_for


def _fit(flat: np.ndarray, owner: np.ndarray, extra: np.ndarray, y: np.ndarray, use: np.ndarray, size: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression on the rows in use: weights of ``size`` columns, bias, weights of the extra columns.

    A column counts by the log ratio of its shares of texts in the two labels, so words that both use alike hardly move.
    """
    keep = use[owner]
    flat, owner = flat[keep], owner[keep]
    ones, zeros = y[use].sum(), (1 - y[use]).sum()
    with_one = np.bincount(flat, y[owner], minlength=size)
    with_zero = np.bincount(flat, minlength=size) - with_one
    ratio = np.log((with_one + 1) / (ones + 2)) - np.log((with_zero + 1) / (zeros + 2))
    share = min(0.98, max(0.02, y[use].mean())) if use.any() else 0.5
    w, b, v = np.zeros(size), np.log(share / (1 - share)), np.zeros(extra.shape[1])
    moments = [np.zeros(size), np.zeros(size), np.zeros(1 + len(v)), np.zeros(1 + len(v))]
    total = max(1, use.sum())
    value = ratio[flat]
    for step in range(1, STEPS + 1):
        margin = np.bincount(owner, w[flat] * value, minlength=len(y)) + b + extra @ v
        error = np.where(use, 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y, 0.0) / total
        slopes = np.bincount(flat, error[owner] * value, minlength=size) + DECAY * w, np.r_[error.sum(), extra.T @ error + DECAY * v]
        moves = []
        for i, g in enumerate(slopes):
            moments[2 * i] = 0.9 * moments[2 * i] + 0.1 * g
            moments[2 * i + 1] = 0.999 * moments[2 * i + 1] + 0.001 * g * g
            moves.append(RATE * (moments[2 * i] / (1 - 0.9**step)) / (np.sqrt(moments[2 * i + 1] / (1 - 0.999**step)) + 1e-8))
        w, b, v = w - moves[0], b - moves[1][0], v - moves[1][1:]
    return w * ratio, float(b), v


def _best_threshold(scores: np.ndarray, y: np.ndarray, stands_for: np.ndarray) -> float:
    order = np.argsort(-scores)
    hits = np.cumsum((y * stands_for)[order])
    f1 = 2 * hits / (np.cumsum(stands_for[order]) + (y * stands_for).sum())
    # Ties are on one side of the threshold together.
    ends = np.r_[scores[order][1:] != scores[order][:-1], True]
    at = int(np.flatnonzero(ends)[f1[ends].argmax()])
    after = scores[order][at + 1] if at + 1 < len(y) else 0.0
    return float((scores[order][at] + after) / 2)


def train(y: np.ndarray, columns: list[np.ndarray], stands_for: np.ndarray, names: list[str]) -> list[Link]:
    """The chain of models, one per category in the given order."""
    if not len(columns):
        return [Link(n, np.zeros(COLUMNS, np.float32), -30.0, np.zeros(i), 2.0) for i, n in enumerate(names)]
    flat, owner = np.concatenate(columns), np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    known = np.flatnonzero(np.bincount(flat, minlength=COLUMNS) >= LEAST_TEXTS)
    keep = np.isin(flat, known)
    flat, owner = np.searchsorted(known, flat[keep]), owner[keep]
    fold = np.arange(len(columns)) % FOLDS
    earlier, chain = np.zeros((len(columns), 0)), []
    for i, name in enumerate(names):
        odds = np.zeros(len(columns))
        for f in range(FOLDS):
            w, b, v = _fit(flat, owner, earlier, y[:, i], fold != f, len(known))
            odds = np.where(fold == f, np.bincount(owner, w[flat], minlength=len(columns)) + b + earlier @ v, odds)
        w, b, v = _fit(flat, owner, earlier, y[:, i], np.ones(len(columns), bool), len(known))
        weights = np.zeros(COLUMNS, np.float32)
        weights[known] = w
        both = 0 < y[:, i].sum() < len(y)
        chain.append(Link(name, weights, b, v, _best_threshold(1 / (1 + np.exp(-np.clip(odds, -30, 30))), y[:, i], stands_for) if both else 2.0))
        earlier = np.c_[earlier, np.clip(odds, -8, 8)]
    return chain


def _scores(links: list[Link], texts: int, owner: np.ndarray, column: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Probabilities of each category for a group of texts, and which texts are flagged."""
    earlier, out = np.zeros((texts, 0)), []
    for link in links:
        odds = np.bincount(owner, link.weights[column], minlength=texts) + link.bias + earlier @ link.earlier
        earlier = np.c_[earlier, np.clip(odds, -8, 8)]
        out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return out, (out[-1] >= links[-1].threshold) & (np.bincount(owner, minlength=texts) > 0)


def classify(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """doc_id, k, a probability p_<category> for each, and flagged (the last category reaches its threshold)."""
    settle(docs.sparkSession)
    names = [f"p_{link.name}" for link in chain]
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, owner, column in _distinct_columns(batch.column(2)):
                out, flagged = _scores(sent.value, hi - lo, owner, column)
                ids = [batch.column(i).slice(lo, hi - lo) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, out), pa.array(flagged)], names=["doc_id", "k", *names, "flagged"])

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text")
    return keyed.mapInArrow(score, f"doc_id {id_type(docs)}, k long, " + ", ".join(f"{n} double" for n in names) + ", flagged boolean")


def fitted(docs: DataFrame, labels: DataFrame) -> list[Link]:
    """The chain for the given labels: junk (quality 0) comes first, toxic reads its probability."""
    settle(docs.sparkSession)
    categories = {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    return train(*sampled(docs, labels, categories), list(categories))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the chain flags; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, owner, column in _distinct_columns(batch.column(batch.schema.get_field_index("text"))):
                keep[lo:hi] = ~_scores(sent.value, hi - lo, owner, column)[1]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
