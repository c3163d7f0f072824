"""Closures, hierarchies and call relations over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .core import LOC, join_null_safe


#: Rounds that a walk takes edge by edge before it builds shortcuts along unbranched paths.
PLAIN_ROUNDS = 8


def _shortcuts(steps: DataFrame, keys: list[str], max_depth: int | None) -> DataFrame:
    """Jumps of 2, 4, 8, ... edges along paths on which every node has one successor, by pointer doubling."""
    proper = steps.filter("node <> next")
    single = proper.groupBy(*keys, "node").agg(F.count("*").alias("n"), F.min("next").alias("next")).filter("n = 1").drop("n")
    jumps, hops, out = cut_lineage(single), 1, []
    # A path without repeats has fewer edges than there are nodes; on a cycle the doubling would never end.
    most = min(single.count(), max_depth or (1 << 30))
    while 2 * hops <= most:
        onward = jumps.select(*keys, F.col("node").alias("next"), F.col("next").alias("then"))
        jumps = cut_lineage(jumps.join(onward, [*keys, "next"]).select(*keys, "node", F.col("then").alias("next")))
        if jumps.isEmpty():
            break
        hops *= 2
        out.append(jumps.withColumn("hops", F.lit(hops)))
    return reduce(DataFrame.unionByName, out, steps.withColumn("hops", F.lit(1)))


def closure(edges: DataFrame, seeds: DataFrame, src: str, dst: str, max_depth: int | None = None, keys=()) -> DataFrame:
    """Nodes reachable from each seed by src -> dst edges, with their least depth; seeds themselves left out.

    ``seeds(target_id, node, *keys)``; edges with the same ``keys`` columns are followed for seeds of equal keys, so
    several relations are walked in one loop. A round moves the fresh nodes along their edges and merges them with the state in one
    grouped exchange, which keeps the least depth and marks what became new or nearer. A walk that is still going after
    ``PLAIN_ROUNDS`` gets shortcuts along unbranched paths, so a path of n nodes takes some log n rounds more; depths
    stay exact, as a node that is reached again by fewer edges is moved on again. The state is the list of what each round found: a round
    writes only that to the checkpoint folder, so a lost executor costs one round at most and plans stay short. Seeds that no edge
    leaves are kept only where they have others beside them that may reach them.
    """
    keys = list(keys)
    key = ["target_id", *keys, "node"]
    steps = cut_lineage(edges.select(*keys, F.col(src).alias("node"), F.col(dst).alias("next")).distinct())
    moves = steps.withColumn("hops", F.lit(1))
    seeds = seeds.select(*key, F.lit(0).alias("depth")).distinct()
    left = steps.select(*keys, "node").distinct()
    several = seeds.groupBy("target_id", *keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    ends = join_null_safe(seeds.join(left, [*keys, "node"], "left_anti"), several, ["target_id", *keys], "left_semi")
    fresh = cut_lineage(seeds.join(left, [*keys, "node"], "left_semi").select(*key, "depth"))
    found, rounds = [cut_lineage(ends.select(*key, "depth")), fresh], 0
    while max_depth is None or rounds < max_depth:
        rounds += 1
        if rounds == PLAIN_ROUNDS + 1:
            moves = _shortcuts(steps, keys, max_depth)
        reached = fresh.join(moves, [*keys, "node"]).select("target_id", *keys, F.col("next").alias("node"), (F.col("depth") + F.col("hops")).alias("depth"))
        if max_depth is not None:
            reached = reached.filter(F.col("depth") <= max_depth)
        state = reduce(DataFrame.unionByName, found)
        both = state.select(*key, "depth", F.col("depth").alias("was")).unionByName(reached.withColumn("was", F.lit(None).cast("int")))
        merged = both.groupBy(*key).agg(F.min("depth").alias("depth"), F.min("was").alias("was"))
        fresh = cut_lineage(merged.filter(F.col("was").isNull() | (F.col("depth") < F.col("was"))).select(*key, "depth"))
        if fresh.isEmpty():
            break
        found.append(fresh)
    state = reduce(DataFrame.unionByName, found)
    if rounds > PLAIN_ROUNDS:
        # Shortcuts may reach a node by more edges first; edge by edge, each is found once.
        state = state.groupBy(*key).agg(F.min("depth").alias("depth"))
    return state.filter("depth > 0").select(*key, "depth")


def walk_relations(seeds: DataFrame, type_edges: DataFrame, relations: dict[str, tuple[list[str], bool]]) -> DataFrame:
    """Closures over several edge kinds and directions at once: relation -> (edge kinds, upwards)."""
    kinds = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(k).alias("edge_kind"), F.lit(up).alias("up"))
                      for r, (of, up) in relations.items() for k in of])
    table = F.filter(kinds, lambda s: s["edge_kind"] == F.col("edge_kind"))
    edges = type_edges.select("child_id", "parent_id", F.explode(table).alias("s"))
    edges = edges.select(
        F.col("s.relation").alias("relation"),
        F.when(F.col("s.up"), F.col("child_id")).otherwise(F.col("parent_id")).alias("src"),
        F.when(F.col("s.up"), F.col("parent_id")).otherwise(F.col("child_id")).alias("dst"),
    )
    if "relation" not in seeds.columns:
        seeds = seeds.withColumn("relation", F.explode(F.array(*[F.lit(r) for r in relations])))
    return closure(edges, seeds, "src", "dst", keys=["relation"])


# Relation -> (edge kinds followed, upwards). A type implements an interface through its base types and
# through interfaces that extend it.
HIERARCHY = {
    "base-type": (["base"], True),
    "derived-type": (["base"], False),
    "implementing-type": (["base", "interface"], False),
    "base-member": (["override"], True),
    "overriding-member": (["override"], False),
    "implemented-member": (["implements"], False),
}


def type_hierarchy(targets: DataFrame, type_edges: DataFrame, relations=(*HIERARCHY, "interface")) -> DataFrame:
    """(target, relation, symbol, depth) rows for the seven relations of a type or member, or for some of them."""
    seeds = targets.select("target_id", F.col("symbol_id").alias("node"))
    followed = {r: of for r, of in HIERARCHY.items() if r in relations}
    direct = type_edges.filter(F.col("edge_kind") == "interface").select(F.col("child_id").alias("node"), "parent_id").distinct()
    interfaces = direct.select(F.col("parent_id").alias("node"), F.lit("implementing-type").alias("relation")).distinct()
    others = F.array(*[F.lit(r) for r in followed if r != "implementing-type"]).cast("array<string>")
    walked = seeds.withColumn("relation", F.explode(others))
    if "implementing-type" in followed:
        walked = walked.unionByName(seeds.join(interfaces, "node"))
    found = walk_relations(walked, type_edges, followed).select("target_id", "relation", F.col("node").alias("symbol_id"), "depth")
    if "interface" not in relations:
        return found
    own = seeds.join(direct, "node").filter(F.col("node") != F.col("parent_id"))
    own = own.select("target_id", F.lit("interface").alias("relation"), F.col("parent_id").alias("symbol_id"), F.lit(1).alias("depth"))
    return found.unionByName(own)


def implementations_of(targets: DataFrame, type_edges: DataFrame) -> DataFrame:
    """Implementing and derived types of open types, implementations and overrides of members, at any depth.

    Where ``targets`` has a column ``is_open`` (interface, abstract type or member), the others give no rows.
    """
    if "is_open" in targets.columns:
        targets = targets.filter("is_open")
    seeds = targets.select("target_id", F.col("symbol_id").alias("node"))
    found = closure(type_edges, seeds, "parent_id", "child_id")
    return found.select("target_id", F.col("node").alias("symbol_id"), "depth")


def related_members(targets: DataFrame, type_edges: DataFrame) -> DataFrame:
    """Each target with the members it overrides or implements and those that override or implement it."""
    seeds = targets.select("target_id", F.col("symbol_id").alias("node"))
    walked = walk_relations(seeds, type_edges, {"up": (["override"], True), "down": (["override", "implements"], False)})
    implemented = type_edges.filter(F.col("edge_kind") == "implements").select(F.col("child_id").alias("node"), "parent_id")
    direct = seeds.join(implemented, "node").select("target_id", F.col("parent_id").alias("node"))
    return seeds.unionByName(walked.select("target_id", "node")).unionByName(direct).distinct()


def callers_of(targets: DataFrame, call_edges: DataFrame, type_edges: DataFrame | None = None) -> DataFrame:
    """Call locations of each (target, caller), related members included; one row per location."""
    if type_edges is None:
        keys = targets.select("target_id", F.col("symbol_id").alias("node"))
    else:
        keys = related_members(targets, type_edges)
    hits = keys.join(call_edges.withColumnRenamed("callee_id", "node"), "node")
    return hits.select("target_id", "caller_id", *LOC).distinct()


def calls_of(targets: DataFrame, call_edges: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Call locations of each (target, callee). ``declared(symbol_id)`` leaves out callees without source.

    An edge belongs to its innermost caller, so calls made by members nested in the target are not its own.
    """
    hits = targets.select("target_id", F.col("symbol_id").alias("caller_id")).join(call_edges, "caller_id")
    if declared is not None:
        hits = hits.join(declared.select(F.col("symbol_id").alias("callee_id")).distinct(), "callee_id", "left_semi")
    return hits.select("target_id", "callee_id", *LOC).distinct()


def call_groups(calls: DataFrame, other: str) -> DataFrame:
    """One row per (target, other symbol): location count and first location."""
    grouped = calls.groupBy("target_id", other).agg(
        F.count("*").alias("location_count"), F.min(F.struct(*LOC)).alias("first")
    )
    return grouped.select("target_id", other, "location_count", "first.*")


def search_scope(targets: DataFrame, project_edges: DataFrame, documents: DataFrame, scope: str) -> DataFrame:
    """Documents to search per target: its file, its project, dependent projects, or everything.

    ``targets(target_id, repo, project, path)``; ``project_edges(from_project, to_project)``. Own document first.
    """
    keys = ["repo", "project"]
    if scope == "file":
        found = targets.join(documents, ["repo", "project", "path"]).select("target_id", *documents.columns)
    elif scope == "project":
        found = targets.drop("path").join(documents, keys).select("target_id", *documents.columns)
    elif scope == "dependent-projects":
        seeds = targets.select("target_id", F.struct("repo", "project").alias("node"))
        ends = project_edges.select(
            F.struct("repo", F.col("to_project").alias("project")).alias("of"),
            F.struct("repo", F.col("from_project").alias("project")).alias("by"),
        )
        dependents = closure(ends, seeds, "of", "by").select("target_id", "node")
        wanted = seeds.unionByName(dependents).select("target_id", "node.*")
        found = wanted.join(documents, keys).select("target_id", *documents.columns)
    else:
        found = targets.select("target_id", "repo").join(documents, "repo").select("target_id", *documents.columns)
    own = targets.select("target_id", F.col("project").alias("__p"), F.col("path").alias("__d"))
    return (
        found.join(own, "target_id")
        .withColumn("is_own", (F.col("project") == F.col("__p")) & (F.col("path") == F.col("__d")))
        .drop("__p", "__d")
    )
