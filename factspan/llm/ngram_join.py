"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

A row's set is its distinct 5-word shingles (the whole sequence where it has fewer words). Rows with equal sets are one class;
classes are joined, and copies follow by membership.

* Columns are ordered by an estimate of how many rows hold them, rare first (a merged sketch; any order gives the same result). A
  class that reaches 75 % with another shares one of its first n - ceil(0.75 n) + 1 columns with it, so only these enter the
  product, and of these only columns of two classes or more. Passages that many texts share come last and hardly ever enter.
* In crowded columns every class is first multiplied with the column's most typical class and with its predecessor, about as
  many pairs as entries, and the pairs that reach 75 % are linked into components: a large group of near copies is joined
  here without its pairs.
* Then the rest of the product is made, only between classes of different components and with sizes within 75 % of each
  other. Blocks of columns that meet the same component are multiplied together, crowded columns tile by tile, and overlap
  counts are accumulated in the block and then over all blocks; a pair is dropped if its count plus what lies beyond both
  prefixes is below the overlap that its sizes ask for. Pairs left are compared on their whole sets.

Null texts and texts without words have the empty set and link with nothing. Repeated rows are members of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .blocks import linked_components, shared_columns
from .common import id_type, keyed_texts, same_row, settle, shared_table
from .sketch import bitmap, cell_rows, merged_cells
from .words import NON_BLANK, U, Words, in_bits, mix, signed, text_groups, words_of

SHINGLE = 5
#: 100 * shared >= PERCENT * union.
PERCENT = 75
CELLS = 1 << 20
BLOCK = 1 << 16


def _sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every text's distinct shingles, by text and hash."""
    at, grams = words.grams(SHINGLE)
    owner = words.text_of_word()[at] if len(at) else at
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            starts, hashes = words.grams(n)
            grams = np.concatenate([grams, hashes[np.searchsorted(starts, words.first[short])]])
            owner = np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])] if len(grams) else np.zeros(0, bool)
    return owner[new], grams[new]


def _classes(owner: np.ndarray, grams: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit hash of every text's set."""
    size = np.bincount(owner, minlength=texts)
    total = np.zeros(texts + 1, U)
    ends = np.searchsorted(owner, np.arange(texts + 1))
    sums = np.zeros(len(grams) + 1, U)
    np.cumsum(mix(grams), dtype=U, out=sums[1:])
    total = sums[ends[1:]] - sums[ends[:-1]]
    return size, mix(total + size.astype(U))


def _measured(docs: DataFrame) -> DataFrame:
    """Per row n and fp (part null); per partition the blocks of its sketch of column counts (n null)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "k", "n", "fp", "part", "block", "cells"]
        cells, ids_type = np.zeros(CELLS, np.uint32), None
        for batch in batches:
            ids_type = batch.column(0).type
            for lo, hi, buf, offsets in text_groups(batch.column(2)):
                owner, grams = _sets(words_of(buf, offsets, NON_BLANK, lower=True))
                size, fp = _classes(owner, grams, hi - lo)
                cells += np.bincount((grams & U(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                none = lambda kind: pa.nulls(hi - lo, kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(signed(fp)), none(pa.int64()), none(pa.int64()), none(pa.binary())],
                    names=names,
                )
        rows = list(cell_rows(cells, TaskContext.get().partitionId(), BLOCK))
        if rows:
            none = lambda kind: pa.nulls(len(rows), kind)
            part, block, packed = zip(*rows)
            yield pa.RecordBatch.from_arrays([none(ids_type), none(pa.int64()), none(pa.int64()), none(pa.int64()), pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(packed, pa.binary())], names=names)

    schema = f"doc_id {id_type(docs)}, k long, n long, fp long, part long, block long, cells binary"
    return keyed_texts(docs).mapInArrow(measure, schema)


def _least_partner(n: np.ndarray) -> np.ndarray:
    return -(-PERCENT * n // 100)


def _prefix_columns(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Entries (gram, n, fp) of every class's prefix; copies inside a partition enter once."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sent.value, set()
        for batch in batches:
            for lo, hi, buf, offsets in text_groups(batch.column(0)):
                owner, grams = _sets(words_of(buf, offsets, NON_BLANK, lower=True))
                size, fp = _classes(owner, grams, hi - lo)
                fresh = np.zeros(hi - lo, bool)
                for i, one in enumerate(fp.tolist()):
                    fresh[i] = one not in seen
                    seen.add(one)
                order = np.lexsort((grams, counts[(grams & U(CELLS - 1)).astype(np.int64)], owner))
                rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
                keep = fresh[owner] & (rank < (size - _least_partner(size) + 1)[owner])
                owner, grams = owner[keep], grams[order][keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams)), pa.array(size[owner].astype(np.int32)), pa.array(signed(fp[owner]))], names=["gram", "n", "fp"])

    return docs.select("text").mapInArrow(cut, "gram long, n int, fp long")


def _whole_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Whole sets (fp, n, grams) of the needed classes (fp, n), from the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(needed, F.col("fp"), 16))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        for batch in batches:
            for lo, hi, buf, offsets in text_groups(batch.column(0)):
                owner, grams = _sets(words_of(buf, offsets, NON_BLANK, lower=True))
                size, fp = _classes(owner, grams, hi - lo)
                keep = in_bits(bits, fp) & (size > 0)
                for i in np.flatnonzero(keep):
                    keep[i] = int(fp[i]) not in seen
                    seen.add(int(fp[i]))
                kept = np.flatnonzero(keep)
                ends = np.r_[0, np.cumsum(size[kept])].astype(np.int32)
                values = pa.array(signed(grams[keep[owner]]) if len(owner) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(signed(fp[kept])), pa.array(size[kept].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), values)], names=["fp", "n", "grams"])

    found = docs.select("text").mapInArrow(take, "fp long, n int, grams array<long>")
    return shared_table(found.join(needed, ["fp", "n"], "left_semi").dropDuplicates(["fp", "n"]))


def _reachable(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pairs whose overlap in the prefixes and all that lies beyond them can reach what their sizes ask for."""
    beyond = np.maximum(_least_partner(rows[:, 1]), _least_partner(rows[:, 3])) - 1
    return (counts + beyond) * (100 + PERCENT) >= (rows[:, 1] + rows[:, 3]) * PERCENT


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    needed = pairs.select(F.col("a").alias("fp"), F.col("an").alias("n")).union(pairs.select("b", "bn")).distinct()
    sets = _whole_sets(docs, needed)
    left, right = sets.select(F.col("fp").alias("a"), F.col("n").alias("an"), F.col("grams").alias("x")), sets.select(F.col("fp").alias("b"), F.col("n").alias("bn"), F.col("grams").alias("y"))
    joined = pairs.join(left, ["a", "an"]).join(right, ["b", "bn"])
    shared = F.size(F.array_intersect("x", "y"))
    return joined.filter(shared * (100 + PERCENT) >= (F.col("an") + F.col("bn")) * PERCENT).select("a", "b")


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, k, n, root (the class that names the row's component) and least (least id of the component), one row per row of ``docs``.

    Rows without words have no component: least is their own id.
    """
    settle(docs.sparkSession)
    measured = shared_table(_measured(docs))
    counts = merged_cells(measured.filter("part is not null").select("part", "block", "cells"), CELLS, BLOCK, "uint32", None)
    entries = _prefix_columns(docs, counts)
    columns = shared_table(shared_columns(entries))
    roots = linked_components(columns, PERCENT, lambda pairs: _linked(docs, pairs), _reachable)
    rows = measured.filter("part is null").select("doc_id", "k", "n", "fp")
    placed = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = placed.filter("n > 0")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = linked.join(least, "root").select("doc_id", "k", "n", "root", "least")
    alone = placed.filter("n = 0").select("doc_id", "k", "n", "root", F.col("doc_id").alias("least"))
    return named.union(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, k, n_shingles and component_id (least id reachable by links), one row per row of ``docs``."""
    return _placed(docs).select("doc_id", "k", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked rows, that of the least id (of several rows with that id, one); all columns stay.

    Groups are told apart by their links alone: rows with a null id, or with one id and unlike texts, are in groups of their own.
    Rows without words are linked with nothing and all stay.
    """
    found = shared_table(_placed(docs))
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("least")))
    once = first.filter("n > 0").groupBy("root").agg(F.min(F.struct("k", "doc_id")).alias("row")).select("row.doc_id", "row.k", F.lit(True).alias("once"))
    empty = first.filter("n = 0").select("doc_id", "k", F.lit(False).alias("once")).distinct()
    stay = once.union(empty).select(F.col("doc_id").alias("__doc"), F.col("k").alias("__k"), F.col("once").alias("__once"))
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    joined = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__k")))
    repeats = found.filter("n > 0").groupBy("doc_id", "k").count().filter("count > 1")
    if not repeats.isEmpty():
        place = F.row_number().over(Window.partitionBy("__row", "doc_id").orderBy(F.lit(0)))
        joined = joined.withColumn("__place", place).filter("not __once or __place = 1")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
