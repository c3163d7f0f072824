"""Blocked sparse product of entries (gram, n, fp): which classes fp, of sizes n, meet in which columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import shared_table
from .components import components

#: Columns of more entries than this are crowded.
CROWD = 32
#: Rounds of stars at most; what they leave is left to the product.
STAR_ROUNDS = 3
#: Entries of a column in one tile of the product, and entries of a block of columns.
TILE = 1024
BLOCK_ENTRIES = 200_000
#: Pairs that a task holds before it passes them on.
HELD_PAIRS = 1_000_000


def _runs(gram: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])


def _shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by (gram, n, fp): columns of two classes or more, each class once, with its place in the column.

    The first class of a column is held back until a second one shows that the column is shared.
    """
    last = held = None
    place = 0
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if len(rows[0]):
            before = last if last is not None else [x[:1] for x in rows]
            differs = np.any([x != np.r_[y, x[:-1]] for x, y in zip(rows, before)], axis=0)
            differs[0] |= last is None
            rows = [x[differs] for x in rows]
        if not len(rows[0]):
            continue
        goes_on = last is not None and held is None and rows[0][0] == last[0][0]
        if held is not None:
            rows = [np.r_[x, y] for x, y in zip(held, rows)]
        gram, n, fp = rows
        starts = _runs(gram)
        length = np.diff(np.r_[starts, len(gram)])
        at = np.arange(len(gram)) - np.repeat(starts, length)
        alone = length == 1
        if goes_on:
            at[: length[0]] += place
            alone[0] = False
        last, place = [x[-1:] for x in rows], int(at[-1]) + 1
        held = last if alone[-1] else None
        out = ~np.repeat(alone, length)
        yield pa.RecordBatch.from_arrays([pa.array(gram[out]), pa.array(n[out].astype(np.int32)), pa.array(fp[out]), pa.array(at[out].astype(np.int64))], names=["gram", "n", "fp", "place"])


def _close(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m).astype(np.int64) >= percent * np.maximum(n, m).astype(np.int64)


def _ordered_pair(x: np.ndarray, y: np.ndarray, n: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Rows (a, an, b, bn) of the classes at x and y, the lesser hash first."""
    flip = fp[x] > fp[y]
    x, y = np.where(flip, y, x), np.where(flip, x, y)
    return np.stack([fp[x], n[x].astype(np.int64), fp[y], n[y].astype(np.int64)], 1)


def _counted(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort((rows[:, 3], rows[:, 1], rows[:, 2], rows[:, 0]))
    rows, counts = rows[order], counts[order]
    starts = np.flatnonzero(np.r_[True, np.any(rows[1:] != rows[:-1], axis=1)])
    return rows[starts], np.add.reduceat(counts, starts)


def _pair_batch(rows: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2]), pa.array(rows[:, 3].astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "an", "b", "bn"])


def _list_batch(rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each first class of sorted pairs, with lists of its partners and counts."""
    starts = np.flatnonzero(np.r_[True, np.any(rows[1:, :2] != rows[:-1, :2], axis=1)]) if len(rows) else np.zeros(0, np.int64)
    ends = pa.array(np.r_[starts, len(rows)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (rows[:, 2], rows[:, 3].astype(np.int32), counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(rows[starts, 0]), pa.array(rows[starts, 1].astype(np.int32)), *lists], names=["a", "an", "b", "bn", "c"])


def _summed(batches: Iterator[pa.RecordBatch], keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of lists sorted by (a, an), and pass on the pairs to keep."""
    held: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        first = [np.repeat(batch.column(i).to_numpy().astype(np.int64), sizes) for i in range(2)]
        b, bn, counts = (batch.column(i).flatten().to_numpy() for i in range(2, 5))
        rows = np.stack([first[0], first[1], b, bn.astype(np.int64)], 1)
        if held is not None:
            rows, counts = np.concatenate([held[0], rows]), np.concatenate([held[1], counts])
        rows, counts = _counted(rows, counts)
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        held = rows[last:], counts[last:]
        fine = keep(rows[:last], counts[:last])
        yield _pair_batch(rows[:last][fine])
    if held is not None:
        yield _pair_batch(held[0][keep(*held)])


def crowded_columns(columns: DataFrame) -> DataFrame:
    """Entries of crowded columns, with the number of crowded columns that hold their class."""
    crowded = columns.join(columns.filter(F.col("place") == CROWD).select("gram"), "gram", "left_semi")
    return crowded.join(crowded.groupBy("fp").agg(F.count("*").alias("columns")), "fp")


def star_pairs(crowded: DataFrame, roots: DataFrame | None, percent: int, order: Column) -> DataFrame:
    """Pairs of different components: each class with its predecessor and with the head of a crowded column in an order."""
    if roots is None:
        rooted = crowded.withColumn("root", F.col("fp"))
    else:
        rooted = crowded.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if tail is not None:
                cols = [np.r_[h, t, c] for h, t, c in zip(head, tail, cols)]
            gram, n, fp, root = cols
            starts = _runs(gram)
            lead = np.repeat(starts, np.diff(np.r_[starts, len(gram)]))
            at = np.arange(2 if tail is not None else 1, len(gram))
            x, y = np.r_[at - 1, lead[at]], np.r_[at, at]
            fine = (gram[x] == gram[y]) & (root[x] != root[y]) & _close(n[x], n[y], percent)
            rows = _ordered_pair(x[fine], y[fine], n, fp)
            tail, head = [c[-1:] for c in cols], [c[lead[-1] : lead[-1] + 1] for c in cols]
            yield _pair_batch(_counted(rows, np.ones(len(rows), np.int64))[0])

    ordered = rooted.repartition("gram").sortWithinPartitions("gram", order, "fp").select("gram", "n", "fp", "root")
    return ordered.mapInArrow(pair, "a long, an int, b long, bn int").distinct()


def _multiply(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs over entries (gram, ti, tj, tile, n, fp, root) that stand tile by tile of a column."""
    open_run: list[np.ndarray] | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def product(cols: list[np.ndarray]) -> Iterator[np.ndarray]:
        gram, ti, tj, tile, n, fp, root = cols
        run = np.cumsum(np.r_[0, (gram[1:] != gram[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])])
        for d in range(1, len(gram)):
            x = np.flatnonzero(run[d:] == run[:-d])
            if not len(x):
                return
            y = x + d
            fine = (root[x] != root[y]) & _close(n[x], n[y], percent) & ((ti[x] == tj[x]) | (tile[x] != tile[y]))
            yield _ordered_pair(x[fine], y[fine], n, fp)

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return _counted(np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]))

    def closing(more: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        nonlocal open_run
        for batch in more:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            if open_run is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(open_run, cols)]
            last = int(np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)])[-1])
            open_run = [c[last:] for c in cols]
            if last:
                yield [c[:last] for c in cols]
        if open_run is not None:
            yield open_run

    for cols in closing(batches):
        for rows in product(cols):
            held.append((rows, np.ones(len(rows), np.int64)))
            size += len(rows)
            if size >= HELD_PAIRS:
                held = [reduced()]
                size = len(held[0][0])
                if size >= HELD_PAIRS // 2:
                    yield _list_batch(*held[0])
                    held, size = [], 0
    if held:
        yield _list_batch(*reduced())


def product(columns: DataFrame, roots: DataFrame, percent: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Pairs (a, an, b, bn) of different components (node, root) that ``keep`` keeps, given the number of columns they share."""
    own = columns.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = own.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("place").alias("top")).filter("lo <> hi")
    load = mixed.groupBy("lo").agg(F.expr(f"sum(top + 1) div {BLOCK_ENTRIES} + 1").alias("parts"))
    blocks = mixed.join(load, "lo").select("gram", "lo", F.expr("pmod(xxhash64(gram), parts)").alias("part"), F.expr(f"top div {TILE}").alias("tiles"))
    tiled = own.join(blocks, "gram").withColumn("tile", F.expr(f"place div {TILE}"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "tiles")))
    tiled = tiled.withColumns({"ti": F.least("tile", "other"), "tj": F.greatest("tile", "other")})
    ordered = tiled.repartition("lo", "part").sortWithinPartitions("lo", "part", "gram", "ti", "tj")
    rows = ordered.select("gram", "ti", "tj", "tile", "n", "fp", "root")
    lists = rows.mapInArrow(lambda batches: _multiply(batches, percent), "a long, an int, b array<long>, bn array<int>, c array<long>")
    met = lists.repartition("a").sortWithinPartitions("a", "an")
    return met.mapInArrow(lambda batches: _summed(batches, keep), "a long, an int, b long, bn int")


def shared_columns(entries: DataFrame) -> DataFrame:
    """Columns of two classes or more: gram, n, fp, and the class's place in the column; repeated entries once."""
    ordered = entries.select("gram", "n", "fp").repartition("gram").sortWithinPartitions("gram", "n", "fp")
    return ordered.mapInArrow(_shared_columns, "gram long, n int, fp long, place long")


def every_pair(rows: np.ndarray, _counts: np.ndarray) -> np.ndarray:
    return np.ones(len(rows), bool)


def linked_components(columns: DataFrame, percent: int, linked: Callable[[DataFrame], DataFrame], keep: Callable[[np.ndarray, np.ndarray], np.ndarray] = every_pair) -> DataFrame:
    """Components (node, root) of all classes that a chain of links joins; ``linked`` checks pairs (a, an, b, bn) exactly.

    Rounds of stars first link the classes of crowded columns; then all that meet in any column and are still apart are compared.
    """
    roots = columns.select(F.col("fp").alias("node"), F.col("fp").alias("root")).limit(0)
    crowded = shared_table(crowded_columns(columns))
    for turn in range(STAR_ROUNDS):
        order = F.col("columns").desc() if turn == 0 else F.xxhash64(F.lit(turn), "fp")
        pairs = shared_table(star_pairs(crowded, roots if turn else None, percent, order))
        if pairs.isEmpty():
            break
        more = shared_table(linked(pairs))
        if more.isEmpty():
            break
        # The stars found so far stand for all earlier links.
        roots = components(more.union(roots.select("node", "root")))
    pairs = shared_table(product(columns, roots, percent, keep))
    if pairs.isEmpty():
        return roots
    return components(linked(pairs).union(roots.select("node", "root")))
