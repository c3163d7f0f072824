"""Language identification by multinomial naive Bayes over hashed character n-grams.

Every partition counts the n-grams of its training texts per language in hashed columns; Spark merges the counts of all of
them into one row a language. The log probabilities of ``LANGUAGES_EACH`` languages at a time are a matrix of bounded size that is
sent to every task, which sums its rows over a batch's n-grams. With more languages than that the texts are scored in several
passes that carry the best language so far and the sum of all probabilities; every language takes part.

Null texts and texts without letters are ``und`` with score 0, and so is every text where nothing was learned. Texts without
a language do not train. Repeated rows each get their row; of languages that are equally likely the first in order of text
wins. An empty table gives an empty result. A very long text takes some sixty bytes a character in its task. Columns other
than doc_id, text and lang are not read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import id_type, settle, shared_table
from .sketch import cell_rows, merged_blocks

GRAMS = (1, 2, 3)
COLUMNS = 1 << 15
SMOOTHING = 0.5
UNKNOWN = "und"
GROUP_CHARS = 1 << 19
#: Languages of one pass: bounds the matrix that is sent to tasks (128 KB a language) and what a task counts before it hands on.
LANGUAGES_EACH = 256


@dataclass
class Model:
    """Languages in order of their text, their log priors, and their counts by column (block: number of the language, cells)."""

    names: list[str]
    prior: np.ndarray
    counts: DataFrame | None


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _columns(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their letter counts, and text and hashed column of every n-gram; what is no letter counts as a blank."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= GROUP_CHARS):
            size += len(texts[hi])
            hi += 1
        lowered = [t.lower() for t in texts[lo:hi]]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(hi - lo), [len(t) for t in lowered])
        letter = _letters()[codes]
        codes = np.where(letter, codes, np.uint32(32))
        owners, columns = [], []
        for n in GRAMS:
            if len(codes) < n:
                continue
            hashed = np.full(len(codes) - n + 1, n, np.uint32)
            for j in range(n):
                hashed = (hashed ^ codes[j : len(codes) - n + 1 + j]) * np.uint32(0x9E3779B1)
                hashed ^= hashed >> np.uint32(15)
            inside = np.flatnonzero((owner[: len(hashed)] == owner[n - 1 :]) & (letter[: len(hashed)] | letter[n - 1 :]))
            owners.append(owner[inside])
            columns.append((hashed[inside] & np.uint32(COLUMNS - 1)).astype(np.int64))
        yield lo, hi, np.bincount(owner[letter], minlength=hi - lo), owners, columns
        lo = hi


def train(docs: DataFrame) -> Model:
    """Counts of all rows of ``docs`` with text and lang."""
    settle(docs.sparkSession)
    rows = docs.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return Model([], np.zeros(0), None)
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang in sorted(cells):
                for part, _block, packed in cell_rows(cells[lang], TaskContext.get().partitionId(), COLUMNS):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([lang], pa.int64()), pa.array([packed], pa.binary())], names=["part", "block", "cells"])
            cells.clear()

        for batch in batches:
            langs = np.array([number[lang] for lang in batch.column(1).to_pylist()], np.int64)
            for lo, hi, _letter, owners, columns in _columns(batch.column(0).to_pylist()):
                for lang in np.unique(langs[lo:hi]).tolist():
                    if lang not in cells:
                        if len(cells) >= LANGUAGES_EACH:
                            yield from handed_on()
                        cells[lang] = np.zeros(COLUMNS, np.int64)
                    texts = np.flatnonzero(langs[lo:hi] == lang)
                    for owner, column in zip(owners, columns):
                        # n-grams stand in the order of their texts
                        starts, ends = np.searchsorted(owner, texts), np.searchsorted(owner, texts, "right")
                        mine = np.concatenate([column[a:b] for a, b in zip(starts, ends)])
                        cells[lang] += np.bincount(mine, minlength=COLUMNS)
        yield from handed_on()

    merged = merged_blocks(rows.mapInArrow(count, "part long, block long, cells binary"), COLUMNS, "int64", None)
    prior = np.log(np.array([counts[name] for name in names], float) / sum(counts.values()))
    return Model(names, prior, shared_table(merged))


def _matrix(model: Model, first: int, last: int) -> np.ndarray:
    """Log probabilities of the languages ``first`` to ``last`` by language and column."""
    table = np.full((last - first, COLUMNS), SMOOTHING)
    for row in model.counts.filter((F.col("block") >= first) & (F.col("block") < last)).collect():
        table[row["block"] - first] += np.frombuffer(zlib.decompress(row["cells"]), np.int64)
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (its posterior probability), one row per row of ``docs``."""
    settle(docs.sparkSession)
    firsts = range(0, max(1, len(model.names)), LANGUAGES_EACH)
    # Of the languages so far: the best one's number (-1: none), its log probability, and the log of the sum of all probabilities.
    carried = docs.select("doc_id", "text", F.lit(-1).alias("best"), F.lit(float("-inf")).alias("top"), F.lit(float("-inf")).alias("all"))
    schema = f"doc_id {id_type(docs)}, text string, best int, top double, all double"

    for first in firsts:
        last = min(first + LANGUAGES_EACH, len(model.names))
        if last == first:
            break
        carried = carried.mapInArrow(_scorer(docs.sparkSession, model, first, last), schema)
        if last < len(model.names):
            carried = shared_table(carried)
    named = docs.sparkSession.sparkContext.broadcast(model.names)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = batch.column("best").to_numpy()
            sure = np.exp(np.where(best >= 0, batch.column("top").to_numpy(), 0.0) - np.where(best >= 0, batch.column("all").to_numpy(), 0.0))
            langs = [named.value[i] if i >= 0 else UNKNOWN for i in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(best >= 0, np.clip(sure, 0, 1), 0.0))], names=["doc_id", "lang_pred", "score"])

    return carried.select("doc_id", "best", "top", "all").mapInArrow(name, f"doc_id {id_type(docs)}, lang_pred string, score double")


def _scorer(spark: SparkSession, model: Model, first: int, last: int):
    """A pass over batches (doc_id, text, best, top, all) that takes in the languages ``first`` to ``last``."""
    sent, prior = spark.sparkContext.broadcast(_matrix(model, first, last)), model.prior[first:last]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        for batch in batches:
            best, top, every = (batch.column(name).to_numpy().copy() for name in ("best", "top", "all"))
            for lo, hi, letters, owners, columns in _columns([t or "" for t in batch.column("text").to_pylist()]):
                total = np.tile(prior, (hi - lo, 1))
                for owner, column in zip(owners, columns):
                    if not len(owner):
                        continue
                    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    for i in range(last - first):
                        total[owner[starts], i] += np.add.reduceat(rows[i][column].astype(float), starts)
                likely, peak = total.argmax(1), total.max(1)
                sums = peak + np.log(np.exp(total - peak[:, None]).sum(1))
                seen = np.flatnonzero(letters)
                better = seen[peak[seen] > top[lo + seen]]
                best[lo + better], top[lo + better] = first + likely[better], peak[better]
                every[lo + seen] = np.logaddexp(every[lo + seen], sums[seen])
            columns_ = [batch.column("doc_id"), batch.column("text"), pa.array(best, pa.int32()), pa.array(top), pa.array(every)]
            yield pa.RecordBatch.from_arrays(columns_, names=["doc_id", "text", "best", "top", "all"])

    return score
