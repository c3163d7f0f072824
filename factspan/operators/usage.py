"""References of targets, usage counts, related and affected files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranks import FILE_REASONS, GROUP_KINDS, USAGE_KINDS, rank_of, value_at
from .core import HOT, LOC, bounded_section, deal, dedupe_first

AFFECTED_REASONS = [
    "contains-changed-symbol",
    "references-changed-symbol",
    "caller-of-changed-symbol",
    "callee-of-changed-symbol",
    "implements-changed-symbol",
]


def references_of(targets: DataFrame, references: DataFrame) -> DataFrame:
    """Reference locations of each target, one row per span."""
    refs = references.withColumnRenamed("target_symbol_id", "symbol_id")
    joined = targets.select("target_id", "symbol_id").join(refs, "symbol_id")
    return dedupe_first(joined, ["target_id", *LOC], ["usage_kind", "project"])


def usage_counts(refs: DataFrame, keys=("target_id",)) -> DataFrame:
    """References per usage kind, with the kind's place in the fixed order."""
    counts = refs.groupBy(*keys, "usage_kind").agg(F.count("*").alias("reference_count"))
    return counts.withColumn("kind_order", rank_of("usage_kind", USAGE_KINDS, 100))


def containing_key(kind, container, name) -> Column:
    """Group key of a containing symbol: kind and qualified name."""
    qualified = F.when(F.trim(container) != "", F.concat(F.col(container), F.lit("."), F.col(name))).otherwise(F.col(name))
    return F.concat(F.col(kind), F.lit(":"), qualified)


def kind_counts() -> Column:
    """Map of usage kind to count in the fixed order of kinds, over rows (usage_kind, n) of one kind each."""
    entries = F.array_sort(F.collect_list(F.struct(rank_of("usage_kind", USAGE_KINDS, 100).alias("o"), "usage_kind", "n")))
    return F.map_from_entries(F.transform(entries, lambda s: F.struct(s["usage_kind"], s["n"])))


def grouped_usage(refs: DataFrame, dimensions: dict[str, str], keys=("target_id",), hot: int = HOT) -> DataFrame:
    """For each dimension (name -> column) and key: count, counts per usage kind, first location.

    The rows of a key are brought together before each is repeated per dimension, so they are counted where they lie and only groups go
    through the second exchange. Where a key has more than ``hot`` rows, rows are spread over so many more tasks by their location.
    """
    keys = list(keys)
    most = refs.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    parts = F.ceil(F.coalesce("__most", F.lit(1)) / F.lit(hot))
    spread = refs.withColumn("__most", most.scalar()).withColumn("__part", F.pmod(F.xxhash64(*LOC), parts)).repartition(*keys, "__part")
    dims = F.array(
        *[
            F.struct(F.lit(name).alias("group_by"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("key"))
            for name, c in dimensions.items()
        ]
    )
    flat = spread.select(*keys, "__part", "usage_kind", *LOC, F.explode(dims).alias("d")).select("*", "d.*")
    group = [*keys, "group_by", "key"]
    here = flat.groupBy(*keys, "__part", "group_by", "key", "usage_kind").agg(F.count("*").alias("n"), F.min(F.struct(*LOC)).alias("first"))
    here = here.groupBy(*keys, "__part", "group_by", "key").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("usage_kind", "n")).alias("kinds"), F.min("first").alias("first")
    )
    # One entry per kind and part of a key, so the lists are short.
    grouped = here.groupBy(*group).agg(
        F.sum("n").alias("reference_count"), F.flatten(F.collect_list("kinds")).alias("kinds"), F.min("first").alias("first")
    )
    total = lambda kind: F.aggregate(
        "kinds", F.lit(0).cast("long"), lambda n, k: F.when(k["usage_kind"].eqNullSafe(kind), n + k["n"]).otherwise(n)
    )
    kinds = F.array_distinct(F.transform("kinds", lambda k: k["usage_kind"]))
    entries = F.array_sort(F.transform(kinds, lambda k: F.struct(rank_of(k, USAGE_KINDS, 100).alias("o"), k.alias("kind"))))
    counts = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["kind"], total(e["kind"]))))
    grouped = grouped.withColumn("usage_kind_counts", counts)
    return grouped.select(
        *keys, "group_by", "key", "reference_count", "usage_kind_counts", "first.*",
        rank_of("group_by", GROUP_KINDS, 100).alias("group_order"),
    )


def files_by_references(refs: DataFrame, limit: int, keys=("target_id",)) -> DataFrame:
    """Per target the files with the most references: count, counts per usage kind, first line; the number of files and whether some
    were left out."""
    keys = list(keys)
    per_kind = refs.groupBy(*keys, "path", "usage_kind").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))
    files = per_kind.groupBy(*keys, "path").agg(
        F.sum("n").alias("reference_count"), F.min("first_line").alias("first_line"), kind_counts().alias("usage_kind_counts")
    )
    return bounded_section(files, [F.desc("reference_count"), "path"], limit, keys)


def file_evidence(df: DataFrame, reason: str, direct: bool | None = None) -> DataFrame:
    """Evidence rows (target, location, reason, direct) of one kind."""
    level = F.lit(direct).cast("boolean").alias("direct")
    return df.select("target_id", *LOC, F.lit(reason).alias("reason"), level)


def evidence_files(evidence: DataFrame, priority: list[str], keys=("target_id",)) -> DataFrame:
    """Evidence rows of all kinds to one row per (key, file).

    Reasons become bits that are or-ed, and no list grows with the data.
    The distinct locations stay rows: see :func:`evidence_locations`.
    """
    return _evidence_files(evidence, priority, keys).drop("__part")


def _evidence_files(evidence: DataFrame, priority: list[str], keys, hot: int = HOT) -> DataFrame:
    """The same with ``__part``: the evidence of a key goes through one exchange, which deals large keys by file (see ``core.deal``)."""
    keys = list(keys)
    bit = F.call_function("shiftleft", F.lit(1), rank_of("reason", priority))
    dealt = deal(evidence.select(*keys, *LOC, bit.alias("__bit"), "direct"), keys, ["path"], hot)
    located = dealt.groupBy(*keys, "__part", *LOC).agg(F.bit_or("__bit").alias("bits"), F.bool_or("direct").alias("direct"))
    files = located.groupBy(*keys, "__part", "path").agg(
        F.bit_or("bits").alias("bits"),
        F.bool_or("direct").alias("direct"),
        F.count("*").alias("location_count"),
        F.min(F.struct("line", "column", "end_line", "end_column")).alias("first"),
    )
    codes = F.array_compact(
        F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.lit(r)) for i, r in enumerate(priority)])
    )
    rank = F.lit(len(priority))
    for i in range(len(priority) - 1, -1, -1):
        rank = F.when(F.col("bits").bitwiseAND(1 << i) != 0, i).otherwise(rank)
    level = F.when(F.col("direct"), "direct").when(~F.col("direct"), "indirect")
    return files.select(
        *keys, "__part", "path", codes.alias("reasons"), rank.alias("reason_rank"), level.alias("impact_level"),
        "location_count", "first.*",
    )


def evidence_locations(evidence: DataFrame, keys=("target_id",)) -> DataFrame:
    return evidence.select(*keys, *LOC).distinct()


def related_files(evidence: DataFrame, limit: int | None = None, hot: int = HOT) -> DataFrame:
    """Files related to each target, best reason first; groups before it limits and keeps the true total."""
    if limit is None:
        return evidence_files(evidence, FILE_REASONS)
    files = _evidence_files(evidence.filter(F.col("target_id").isNotNull()), FILE_REASONS, ["target_id"], hot)
    order = ["reason_rank", F.coalesce("impact_level", F.lit("")), "path"]
    # A part is counted and cut where it lies; only its first files go through the next exchange.
    part, target = Window.partitionBy("target_id", "__part"), Window.partitionBy("target_id")
    heads = files.withColumn("__files", F.count("*").over(part)).withColumn("__at", F.row_number().over(part.orderBy(*order)))
    heads = heads.filter(F.col("__at") <= limit)
    kept = heads.withColumn("position", F.row_number().over(target.orderBy(*order))).withColumn(
        "total", F.sum(F.when(F.col("__at") == 1, F.col("__files"))).over(target)
    )
    kept = kept.filter(F.col("position") <= limit).drop("__part", "__files", "__at")
    return kept.withColumn("truncated", F.col("total") > limit)


def affected_files(evidence: DataFrame) -> DataFrame:
    """Files a changed symbol affects; ``direct`` sorts before ``indirect``."""
    files = evidence_files(evidence, AFFECTED_REASONS)
    codes = F.array_sort("reasons")
    return files.withColumn("reasons", codes).withColumn(
        "level_order", F.when(F.col("impact_level") == "direct", 0).otherwise(1)
    )


def diagnostics_scope(diff_files: DataFrame, affected: DataFrame, keys=("change_id",)) -> DataFrame:
    """Path with its sorted reasons: changed-file, affected-file."""
    both = diff_files.select(*keys, "path", F.lit(2).alias("bit")).unionByName(
        affected.select(*keys, "path", F.lit(1).alias("bit"))
    )
    scope = both.groupBy(*keys, "path").agg(F.bit_or("bit").alias("bits"))
    codes = F.array_compact(
        F.array(
            F.when(F.col("bits").bitwiseAND(1) != 0, "affected-file"),
            F.when(F.col("bits").bitwiseAND(2) != 0, "changed-file"),
        )
    )
    return scope.select(*keys, "path", codes.alias("reasons"))


def merge_partials(decls: DataFrame) -> DataFrame:
    """Partial declarations of one symbol: modifier union, part count, first location."""
    parts = decls.groupBy("symbol_id").agg(
        F.count("*").alias("part_count"), F.min(F.struct(*LOC)).alias("first")
    )
    modifiers = (
        decls.select("symbol_id", F.explode("modifiers").alias("modifier"))
        .distinct()
        .groupBy("symbol_id")
        .agg(F.array_sort(F.collect_list("modifier")).alias("modifiers"))
    )
    empty = F.array().cast("array<string>")
    return parts.join(modifiers, "symbol_id", "left").select(
        "symbol_id", "part_count", (F.col("part_count") > 1).alias("is_partial"),
        F.coalesce("modifiers", empty).alias("modifiers"), "first.*",
    )
