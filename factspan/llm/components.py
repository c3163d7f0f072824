"""Connected components of links by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import shared_table

#: Links that one task joins into stars.
LINKS_PER_TASK = 500_000


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one partition as stars around its least nodes: no more links than nodes, and the same connections."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, root(x)) for x in parent if root(x) != x], columns=["a", "b"], dtype="int64")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either linked to one lesser node or is the centre of such links."""
    nodes = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("b", F.lit(0), F.lit(1)))
    degrees = nodes.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return degrees.filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (least node of its component) for every node that has a link; node ids are longs.

    Each partition first reduces its links to a forest, so a crowded component costs no more than its nodes. What is left is
    dealt to as many tasks as its number asks for, which do so again. If these were several, links move to ever smaller
    neighbours until only stars are left, a number of rounds that grows with the logarithm of the longest path.
    """
    known = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    trees = shared_table(known.mapInPandas(_forest, "a long, b long"))
    tasks = max(1, -(-trees.count() // LINKS_PER_TASK))
    now = shared_table(trees.repartition(tasks).mapInPandas(_forest, "a long, b long"))
    while tasks > 1 and not _are_stars(now):
        # Large star: larger neighbours of every node move to the least of its neighbourhood.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: every node and its smaller neighbours move to the least of these.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        moved = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = shared_table(moved.distinct())
    centres = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(centres.select(F.col("b").alias("node"), F.col("b").alias("root")))
