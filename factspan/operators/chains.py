"""Caller chains as k best paths: tails are kept per (symbol, steps left), however many callers a symbol has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .core import top_per_group


def _cycles(edges: DataFrame, length: int) -> DataFrame:
    """(node, tail): simple cycles of ``length`` steps from every node back to itself."""
    if length == 1:
        return edges.filter("node = next").select("node", F.array("node", "next").alias("tail"))
    proper = edges.filter("node <> next")
    if length > 2:
        # Only edges between symbols that have both callers and callees can lie on a cycle.
        for _ in range(length):
            proper = proper.join(proper.select(F.col("next").alias("node")).distinct(), "node", "left_semi")
            proper = proper.join(proper.select(F.col("node").alias("next")).distinct(), "next", "left_semi")
            proper = cut_lineage(proper)
    paths = proper.select("node", F.array("node", "next").alias("tail"), F.col("next").alias("last"))
    onward = proper.select(F.col("node").alias("last"), F.col("next").alias("then"))
    for _ in range(length - 2):
        longer = paths.join(onward, "last").filter(~F.array_contains("tail", F.col("then")))
        paths = longer.select("node", F.concat("tail", F.array("then")).alias("tail"), F.col("then").alias("last"))
    back = onward.withColumnRenamed("then", "node")
    return paths.join(back, ["last", "node"]).select("node", F.concat("tail", F.array("node")).alias("tail"))


def _kept(depth: int, limit: int) -> list[tuple[int, int]]:
    """Per number of steps: tails to keep of one branch (a symbol's tails through one caller), and of a symbol.

    A tail may be of no use to a chain that comes to it, because the chain already holds one of its symbols; then that chain ends
    there, earlier and so before the tail's own chain, and all tails that begin alike up to that symbol make one such chain. With q
    symbols before the tail, q branches may be lost whole, and in the others up to as many tails as a branch of the
    next symbol holds make one chain; beyond q whole branches and ``limit`` times that many tails no tail can be needed.
    """
    sizes, branch, below = [(1, 1)], 1, 1
    for steps in range(1, depth + 1):
        own = (depth - steps) * branch + limit * below
        sizes.append((branch, own))
        below, branch = branch, own + 1
    return sizes


def upstream_chains(targets: DataFrame, call_edges: DataFrame, places: DataFrame, depth: int = 3, limit: int = 20) -> DataFrame:
    """Caller chains of each target, shortest first, then by the place of their last symbol, then by their symbols.

    ``places(symbol_id, path, line, column)``. A chain ends at a repeated symbol, past ``depth`` steps, or where nobody calls it.

    The best tails of a symbol with n steps come from its callers' best tails with n - 1 steps, since putting one symbol before
    tails keeps their order. Tails are kept by kind (ending where nobody calls, ending in a cycle, or open) and cut to what
    :func:`_kept` proves sufficient, so a level is a join of the edges with a bounded number of tails each and the work is edges
    times ``limit`` times ``depth`` (for ``depth`` up to 3; the bound on tails grows with greater depths), never the number of chains.
    Cycles of three steps and more are only asked for by a ``depth`` of four and more, and walked among symbols that can lie on one.
    """
    known = cut_lineage(call_edges.select(F.col("callee_id").alias("node"), F.col("caller_id").alias("next")).distinct())
    near = [targets.select(F.col("symbol_id").alias("node")).distinct()]
    for _ in range(depth):
        near.append(near[-1].join(known, "node").select(F.col("next").alias("node")).distinct())
    nodes = reduce(DataFrame.union, near).distinct()
    place = places.groupBy(F.col("symbol_id").alias("node")).agg(F.min(F.struct("path", "line", "column")).alias("place"))
    called = known.select("node").distinct().withColumn("called", F.lit(True))
    nowhere = F.struct(*[F.lit(None).cast(places.schema[c].dataType).alias(c) for c in ("path", "line", "column")])
    marked = cut_lineage(nodes.join(place, "node", "left").join(called, "node", "left").withColumn("place", F.coalesce("place", nowhere)))
    edges = cut_lineage(known.join(marked.select("node"), "node", "left_semi").join(marked.select(F.col("node").alias("next")), "next", "left_semi"))

    tail = marked.select("node", F.array("node").alias("tail"), "place", "called")
    tails = tail.withColumn("kind", F.lit("open")).unionByName(tail.filter("called is null").withColumn("kind", F.lit("end")))
    tails = tails.select("node", "kind", "tail", "place")
    levels, sizes = [tails], _kept(depth, limit)
    for steps in range(1, depth + 1):
        branch, own = sizes[steps]
        onward = tails.withColumnRenamed("node", "next")
        # The last symbol of an open tail may repeat one before it: that is where the chain would end anyway.
        inside = F.when(F.col("kind") == "open", F.slice("tail", 1, F.size("tail") - 1)).otherwise(F.col("tail"))
        longer = edges.join(onward, "next").filter(~F.array_contains(inside, F.col("node")))
        longer = longer.select("node", "kind", F.concat(F.array("node"), "tail").alias("tail"), "place")
        if steps < depth:
            back = _cycles(edges, steps).join(marked.select("node", "place"), "node")
            longer = longer.unionByName(back.select("node", F.lit("cycle").alias("kind"), "tail", "place"))
            if steps > 2:
                order = ["place", "tail"]
                longer = top_per_group(longer.withColumn("branch", F.col("tail")[1]), ["node", "kind", "branch"], order, branch + 1).drop("branch", "position")
        tails = cut_lineage(top_per_group(longer, ["node", "kind"], ["place", "tail"], own).drop("position"))
        levels.append(tails)

    asked = targets.select("target_id", F.col("symbol_id").alias("node"))
    found = []
    for steps, level in enumerate(levels):
        ended = level.filter(F.col("kind") == "open" if steps == depth else F.col("kind") != "open")
        best = top_per_group(ended, ["node"], ["place", "tail"], limit).drop("position")
        found.append(best.withColumn("chain_length", F.lit(steps + 1)))
    chains = asked.join(reduce(DataFrame.unionByName, found), "node")
    last = F.element_at("tail", -1)
    repeated = F.array_contains(F.slice("tail", 1, F.size("tail") - 1), last)
    reason = F.when(repeated, "cycle-detected").when(F.col("chain_length") > depth, "depth-limit").otherwise("no-upstream-callers")
    rows = chains.select("target_id", F.col("tail").alias("chain"), last.alias("terminal_id"), reason.alias("end_reason"), "chain_length", "place.*")
    return top_per_group(rows, ["target_id"], ["chain_length", "path", "line", "column", "chain"], limit)


def annotate_chains(chains: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Chains whose last symbol sits on a framework entrypoint get that end reason and the entrypoint's kind."""
    places = entrypoints.groupBy("path", "line", "column").agg(F.min("entrypoint_kind").alias("entrypoint_kind"))
    joined = chains.join(places, ["path", "line", "column"], "left")
    reason = F.when(F.col("entrypoint_kind").isNotNull(), "framework-entrypoint").otherwise(F.col("end_reason"))
    return joined.withColumn("end_reason", reason)
