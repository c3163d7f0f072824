"""Sketches of bounded size that are filled per partition and merged by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS_MOST = 27
#: 64-bit words of a bitmap that are sent to the driver as one binary value.
BLOCK_WORDS = 1 << 15
FAN_IN = 64


def bitmap(df: DataFrame, value: Column, bits_each: int = 64) -> np.ndarray:
    """A bitmap with the bit of every value set, at most 2^27 bits (16 MB) however many values there are.

    Too many values only let more pass. Spark merges the words of 64 bits and packs them; the driver gets at most 64 packed blocks.
    """
    values = df.select(value.alias("v")).filter("v is not null")
    count = values.count()
    power = min(BITS_MOST, max(13, (count * bits_each).bit_length()))
    at = values.select(F.col("v").bitwiseAND((1 << power) - 1).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))

    def blocks(key, rows):
        block = np.zeros(min(BLOCK_WORDS, (1 << power) // 64), np.int64)
        block[rows["word"].to_numpy() % BLOCK_WORDS] = rows["bits"].to_numpy()
        return pa.table({"block": [key[0].as_py()], "bits": pa.array([zlib.compress(block.tobytes(), 1)], pa.binary())})

    merged = words.groupBy(F.expr(f"word div {BLOCK_WORDS}").alias("block")).applyInArrow(blocks, "block long, bits binary")
    out = np.zeros((1 << power) // 8, np.uint8)
    for row in merged.collect():
        block = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        out[row["block"] * BLOCK_WORDS * 8 :][: len(block)] = block
    return out


def cell_rows(cells: np.ndarray, part: int, block: int) -> Iterator[tuple[int, int, bytes]]:
    """Non-empty blocks of a partition's cells, compressed."""
    for i in range(0, len(cells), block):
        piece = cells[i : i + block]
        if piece.any():
            yield part, i // block, zlib.compress(piece.tobytes(), 1)


def merged_blocks(rows: DataFrame, block: int, dtype: str, most: int | None) -> DataFrame:
    """(block, cells): sum of all partitions' cells (part, block, cells), each held at ``most``; merged in two levels by Spark."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.int64)
        for cells in frame["cells"]:
            total += np.frombuffer(zlib.decompress(cells), dtype)
        if most is not None:
            np.minimum(total, most, out=total)
        return pd.DataFrame({"part": [0], "block": [int(frame["block"].iloc[0])], "cells": [zlib.compress(total.astype(dtype).tobytes(), 1)]})

    schema = "part long, block long, cells binary"
    near = rows.withColumn("near", F.expr(f"part div {FAN_IN}"))
    first = near.groupBy("block", "near").applyInPandas(add, schema)
    return first.groupBy("block").applyInPandas(add, schema).select("block", "cells")


def merged_cells(rows: DataFrame, size: int, block: int, dtype: str, most: int | None) -> np.ndarray:
    """All merged cells. The driver receives one row per block, so never more than the sketch's own size."""
    out = np.zeros(size, dtype)
    for row in merged_blocks(rows, block, dtype, most).collect():
        out[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(zlib.decompress(row["cells"]), dtype)
    return out
