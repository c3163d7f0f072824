"""Benchmark decontamination by winnowing.

Of every ``WIDTH`` consecutive 5-word grams the one with the least hash is a fingerprint, in documents and benchmark items
alike, so any 10 shared words share a fingerprint at the same place. Document fingerprints that a bitmap of the benchmark's
fingerprints lets pass are extended to the 10-word windows that chose them; these are joined with the benchmark's windows by
two independent 64-bit hashes. Items of fewer than 10 words are one window each, and documents' runs of just those lengths
are looked up in the same way.

Null or empty texts have no words and are clean; items without words match nothing; items with a null id count as hits but
not among the items. Repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import id_type, keyed_texts, same_row, settle, shared_table
from .sketch import bitmap
from .words import LETTERS_DIGITS, Words, in_bits, signed, text_groups, winnow, words_of

WINDOW = 10
GRAM = 5
WIDTH = WINDOW - GRAM + 1
#: Benchmark windows up to this number are sent to every task; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def _fingerprinted(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start of every full window, and the hash of the gram that it chose."""
    at, grams = words.grams(GRAM)
    first, chosen = winnow(at, grams, words.text_of_word()[at], WIDTH)
    return at[first], grams[chosen]


def _windows(words: Words, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    at, one = words.grams(length)
    _, two = words.grams(length, second=True)
    where = np.searchsorted(at, starts)
    return one[where], two[where]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, length, h1, h2 (window) and fp (its fingerprint) of all windows of all items."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offsets in text_groups(batch.column(1)):
                words = words_of(buf, offsets, LETTERS_DIGITS, lower=True)
                parts = []
                starts, fps = _fingerprinted(words)
                parts.append((starts, np.full(len(starts), WINDOW), fps, *_windows(words, starts, WINDOW)))
                for n in np.unique(words.counts[(words.counts > 0) & (words.counts < WINDOW)]):
                    starts = words.first[:-1][words.counts == n]
                    h1, h2 = _windows(words, starts, int(n))
                    parts.append((starts, np.full(len(starts), n), h1, h1, h2))
                start, length, fp, h1, h2 = (np.concatenate(x) for x in zip(*parts))
                owner = words.text_of_word()[start] + lo if len(start) else start
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner)), pa.array(length.astype(np.int32)), pa.array(signed(h1)), pa.array(signed(h2)), pa.array(signed(fp))],
                    names=["item_id", "length", "h1", "h2", "fp"],
                )

    return benchmark.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, length int, h1 long, h2 long, fp long")


def _candidates(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """Per row its number of words (start null), and the windows whose fingerprint passes the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, hi, buf, offsets in text_groups(batch.column(2)):
                words = words_of(buf, offsets, LETTERS_DIGITS, lower=True)
                starts, fps = _fingerprinted(words)
                starts = starts[in_bits(bits, fps)]
                found = [(starts, np.full(len(starts), WINDOW), *_windows(words, starts, WINDOW))]
                for n in short:
                    at, one = words.grams(n)
                    at = at[in_bits(bits, one)]
                    found.append((at, np.full(len(at), n), *_windows(words, at, n)))
                start, length, h1, h2 = (np.concatenate(x) for x in zip(*found))
                owner = words.text_of_word()[start] if len(start) else start
                texts, rows = hi - lo, np.concatenate([np.arange(hi - lo), owner]).astype(np.int64)
                empty = np.arange(len(rows)) < texts
                pad = lambda x: pa.array(np.concatenate([np.zeros(texts, x.dtype), x]), mask=empty)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows + lo)), keys.take(pa.array(rows + lo)),
                        pa.array(np.concatenate([words.counts, np.zeros(len(start), np.int64)]).astype(np.int64), mask=~empty),
                        pad((start - words.first[owner]).astype(np.int64) if len(start) else start.astype(np.int64)),
                        pad(length.astype(np.int32)), pad(signed(h1)), pad(signed(h2)),
                    ],
                    names=["doc_id", "k", "n_words", "start", "length", "h1", "h2"],
                )

    schema = f"doc_id {id_type(docs)}, k long, n_words long, start long, length int, h1 long, h2 long"
    return keyed_texts(docs).mapInArrow(find, schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, k, n_words, n_hit, items (sorted array of item ids as strings) and contaminated, one row per row of ``docs``."""
    settle(docs.sparkSession)
    windows = shared_table(benchmark_windows(benchmark))
    bits = bitmap(windows, F.col("fp"))
    short = sorted(r[0] for r in windows.filter(F.col("length") < WINDOW).select("length").distinct().collect())
    found = shared_table(_candidates(docs, bits, short))
    known = windows.groupBy("length", "h1", "h2").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    if windows.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    hits = found.filter("start is not null").join(known, ["length", "h1", "h2"])
    order = Window.partitionBy("doc_id", "k").orderBy("start", "length")
    until = F.col("start") + F.col("length")
    reached = F.coalesce(F.max(until).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Repeated rows have the same windows: the second copy adds no covered word.
    new = hits.select("doc_id", "k", F.greatest(F.lit(0), until - F.greatest("start", reached)).alias("new"))
    covered = new.groupBy("doc_id", "k").agg(F.sum("new").alias("n_hit"))
    owners = hits.select("doc_id", "k", F.explode("items").alias("item")).distinct()
    items = owners.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list("item")).alias("items"))
    base = found.filter("start is null").select("doc_id", "k", "n_words")
    out = same_row(same_row(base, covered), items)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "k", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold any window of the benchmark; all columns stay."""
    judged = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("__doc"), F.col("k").alias("__k")).distinct()
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    return keyed.join(judged, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__k")), "left_anti").drop("__row")
