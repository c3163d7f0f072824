"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to blocks of 8 dimensions, and each block is decoded to the nearest point of the E8
lattice; the points of a table's blocks name a cell. A vector also enters the cells next to its own that lie in the
direction of its rounding error. Vectors that meet in a cell of any table are candidates, and candidates of cosine 0.95 or
more in double precision are linked. A crowded cell is first linked by its head and shuffled neighbours, so a large group of
near-equal vectors needs no pairs; then all candidates that are still in different components are compared.

The number of links is counted inside each component, tile by tile, over all its vectors, so links inside a component are
all found. Equal vectors are one class and are counted by its size. Vectors that are null, zero, or hold null or
non-finite components, and those with a null id, link with nothing; vectors of different lengths do not link.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import linked_components, shared_columns
from .common import settle, shared_table
from .words import U, mix, signed

COSINE = 0.95
#: Tables at LEAST_BLOCKS blocks; see :func:`tables_of`.
TABLES = 6
LEAST_BLOCKS = 3
#: Scale of the unit sphere before decoding: a step of one lattice cell is about 0.6 / SCALE in the 8 projected dimensions.
SCALE = 4.0
#: Neighbouring cells probed for each block.
PROBES = 2
#: Cells that one block of 8 dimensions tells apart, about; blocks are added with the logarithm of the number of vectors.
CELLS_PER_BLOCK = 150
SEED = 20_240_229
TILE = 512


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [[s if k == i else t if k == j else 0.0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (-1.0, 1.0) for t in (-1.0, 1.0)]
    halves = [h for h in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0]
    return np.array(pairs + [list(h) for h in halves])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum: round, and turn the worst coordinate the other way where the sum is odd."""
    out = np.rint(x)
    error = x - out
    odd = np.flatnonzero(out.sum(1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(1)
    out[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return out


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row of 8 coordinates: of D8, or of D8 moved by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def _point_hash(points: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(points), salt, U)
    for column in (2 * points).astype(np.int64).T:
        out = mix(out ^ (column.view(U) * U(0x9E3779B97F4A7C15) + U(salt)))
    return out


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int, scale: float) -> np.ndarray:
    """Cells of each unit vector: its own and the probed ones of every table, one column each."""
    dims, shortest, out = unit.shape[1], _shortest(), []
    rng = np.random.default_rng(SEED + dims)
    for table in range(tables):
        own, others = [], []
        for block in range(blocks):
            axes = np.linalg.qr(rng.standard_normal((max(dims, 8), 8)))[0][:dims]
            x = unit @ axes * (scale * math.sqrt(dims / 64))
            point = nearest_e8(x)
            own.append(_point_hash(point, table * 64 + block + 1))
            towards = np.argsort(-((x - point) @ shortest.T), axis=1)[:, :probes]
            others.append([_point_hash(point + shortest[towards[:, i]], table * 64 + block + 1) for i in range(probes)])
        join = lambda parts: mix(np.bitwise_xor.reduce(np.stack([mix(p + U(i)) for i, p in enumerate(parts)]), axis=0) + U(table))
        out.append(join(own))
        for block in range(blocks):
            for other in others[block]:
                out.append(join([other if i == block else o for i, o in enumerate(own)]))
    return np.stack(out, 1)


def tables_of(tables: int, blocks: int) -> int:
    """Tables at a number of blocks, given those at LEAST_BLOCKS.

    A pair must agree in every block of a table, so each further block makes that rarer; twice the tables make up for it. Of 4,000
    pairs at cosine 0.95 a share of 0.9895 met in a cell with 3 blocks, and with 4, 5 and 6 as many from 12, 20 and 39 tables on.
    """
    return tables * 2 ** (blocks - LEAST_BLOCKS)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors in double precision, for each length of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)
    starts = column.offsets.to_numpy()[:-1]
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _is_usable() -> Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _linked(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) whose vectors reach the cosine."""
    left = classes.select(F.col("fp").alias("a"), F.col("embedding").alias("x"))
    right = classes.select(F.col("fp").alias("b"), F.col("embedding").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for (rows, x), (_, y) in zip(_by_length(batch.column(2)), _by_length(batch.column(3))):
                near[rows] = (_unit(x) * _unit(y)).sum(1) >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(near))

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").filter(F.size("x") == F.size("y"))
    return joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _degrees(members: DataFrame, cosine: float) -> DataFrame:
    """fp, links: over the members (fp, m, root, embedding) of components, the vectors within the cosine of each, tile against tile."""
    sizes = members.groupBy("root").agg(F.expr(f"count(*) div {TILE}").alias("tiles"))
    tiled = members.join(sizes, "root").withColumn("tile", F.expr("pmod(xxhash64(fp), tiles + 1)"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "tiles")))

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        own, others = frame[frame["tile"] == key[1]], frame[frame["tile"] == key[2]]
        for n in own["embedding"].map(len).unique():
            a, b = own[own["embedding"].map(len) == n], others[others["embedding"].map(len) == n]
            if not len(b):
                continue
            x, y = (_unit(np.stack(part["embedding"].to_numpy()).astype(float)) for part in (a, b))
            weight = b["m"].to_numpy(float)
            for lo in range(0, len(a), TILE):
                near = (x[lo : lo + TILE] @ y.T >= cosine) & (a["fp"].to_numpy()[lo : lo + TILE, None] != b["fp"].to_numpy()[None, :])
                out.append(pd.DataFrame({"fp": a["fp"].to_numpy()[lo : lo + TILE], "links": (near @ weight).astype("int64")}))
        return pd.concat(out) if out else pd.DataFrame({"fp": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})

    # Each ordered pair of tiles: rows of the first are counted against rows of the second.
    first = tiled.withColumns({"left": F.col("tile"), "right": F.col("other")})
    second = tiled.filter("tile <> other").withColumns({"left": F.col("other"), "right": F.col("tile")})
    both = first.union(second).select("root", "left", "right", "tile", "fp", "m", "embedding")
    counted = both.groupBy("root", "left", "right").applyInPandas(count, "fp long, links long")
    return counted.groupBy("fp").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``vectors``."""
    settle(vectors.sparkSession)
    usable = vectors.filter(_is_usable()).select("vec_id", "embedding")
    # A class is named by a hash of its vector.
    classes = shared_table(usable.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("m")).withColumn("fp", F.xxhash64("embedding")))
    blocks = max(LEAST_BLOCKS, math.ceil(math.log(max(2, classes.count())) / math.log(CELLS_PER_BLOCK)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for rows, x in _by_length(batch.column(1)):
                found = cells(_unit(x), tables_of(tables, blocks), blocks, probes, scale)
                gram = signed(found.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.ones(len(gram), np.int32)), pa.array(np.repeat(names[rows], found.shape[1]))], names=["gram", "n", "fp"])

    entries = classes.select("fp", "embedding").mapInArrow(place, "gram long, n int, fp long")
    columns = shared_table(shared_columns(entries))
    roots = shared_table(linked_components(columns, 0, lambda pairs: _linked(pairs, classes, cosine)))
    members = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    degrees = _degrees(members.select("fp", "m", "root", "embedding"), cosine)
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    known = members.join(least, "root").join(degrees, "fp", "left").select("fp", "component_id", "links")
    placed = classes.join(known, "fp", "left").select(
        F.col("embedding").alias("__vector"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    rows = usable.join(placed, F.col("embedding") == F.col("__vector")).select("vec_id", "n_links", "component_id")
    alone = vectors.filter(~_is_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

