"""Comparison of two API snapshots.

Symbols: doc_id, kind, container, name, signature, modifiers, parameters, generic_constraints,
nullable_annotations, default_values, attributes, path, line, column; any further key columns (repo, change)
are named by ``keys``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranks import reasons
from ..session import cut_lineage
from .core import any_of, bounded_section, dedupe_first, number_rows

SIDE = ["kind", "container", "name", "path", "line", "column"]
POLYMORPHIC = ["abstract", "virtual", "sealed", "override"]

# Code -> (source risk, binary risk, confidence).
CHANGE_RISKS = {
    "generic-constraints-changed": ("breaking", "risk", "medium"),
    "nullable-annotation-changed": ("risk", "compatible", "medium"),
    "default-parameter-changed": ("risk", "risk", "medium"),
    "abstract-virtual-sealed-changed": ("breaking", "risk", "medium"),
    "enum-member-value-changed": ("risk", "breaking", "high"),
    "attribute-added": ("risk", "risk", "medium"),
    "attribute-removed": ("risk", "risk", "medium"),
    "attribute-argument-changed": ("risk", "risk", "medium"),
    "public-signature-changed": ("breaking", "breaking", "high"),
    "interface-member-added": ("breaking", "breaking", "high"),
}
CHANGE_ORDER = ["risk_order", "code", "container", "name", "path", "line", "column", "doc_id"]


def api_snapshot(symbols: DataFrame, limit: int | None = None, keys=()) -> DataFrame:
    """One row per id, ordered by id; with a limit also total and truncated per snapshot."""
    unique = dedupe_first(symbols, [*keys, "doc_id"], ["path", "line", "column", "name"])
    return unique if limit is None else bounded_section(unique, ["doc_id"], limit, keys)


def _sides(base: DataFrame, head: DataFrame, keys) -> DataFrame:
    """Inner pairs by id, each side as a struct."""
    key = [*keys, "doc_id"]
    left = base.select(*key, F.struct(*[c for c in base.columns if c not in key]).alias("before"))
    right = head.select(*key, F.struct(*[c for c in head.columns if c not in key]).alias("after"))
    return left.join(right, key)


def _risk(index: int, default: str) -> Column:
    expr = F.lit(default)
    for code, risks in CHANGE_RISKS.items():
        expr = F.when(F.col("code") == code, risks[index]).otherwise(expr)
    return expr


def _finish(df: DataFrame, keys) -> DataFrame:
    removal = F.col("change") == "removal"
    default = lambda i: F.when(removal, F.lit("breaking")).otherwise(_risk(i, "compatible"))
    out = df.withColumn("source_risk", default(0)).withColumn("binary_risk", default(1)).withColumn("confidence", _risk(2, "high"))
    order = (
        F.when(F.col("binary_risk") == "breaking", 0)
        .when(F.col("source_risk") == "breaking", 1)
        .when((F.col("source_risk") == "risk") | (F.col("binary_risk") == "risk"), 2)
        .otherwise(3)
    )
    return out.withColumn("risk_order", order).select(
        *keys, "code", "change", "doc_id", *SIDE, "source_risk", "binary_risk", "confidence", "risk_order",
        "base_path", "base_line", "base_column", "head_path", "head_line", "head_column",
    )


def _evidence(before: str | None, after: str | None) -> list[Column]:
    def one(side: str | None, label: str) -> list[Column]:
        types = {"path": "string", "line": "int", "column": "int"}
        return [
            (F.col(f"{side}.{c}") if side else F.lit(None)).cast(t).alias(f"{label}_{c}") for c, t in types.items()
        ]

    return one(before, "base") + one(after, "head")


def diff_matched(base: DataFrame, head: DataFrame, include_attributes: bool = True, keys=()) -> DataFrame:
    """Same id on both sides: one row per changed facet."""
    return _facet_changes(_sides(base, head, keys), include_attributes, keys)


def _facet_changes(sides: DataFrame, include_attributes: bool, keys) -> DataFrame:
    """One row per changed facet of ``sides(keys, doc_id, before, after)``."""

    def differs(facet: str) -> Column:
        return ~F.col(f"before.{facet}").eqNullSafe(F.col(f"after.{facet}"))

    def has(side: str, word: str) -> Column:
        return F.coalesce(F.array_contains(f"{side}.modifiers", word), F.lit(False))

    count = lambda side: F.coalesce(F.array_size(f"{side}.attributes"), F.lit(0))
    attribute_code = (
        F.when(count("before") < count("after"), "attribute-added")
        .when(count("before") > count("after"), "attribute-removed")
        .otherwise("attribute-argument-changed")
    )
    facets = [
        (differs("generic_constraints"), "generic-constraints-changed"),
        (differs("nullable_annotations"), "nullable-annotation-changed"),
        (differs("default_values"), "default-parameter-changed"),
        (any_of(has("before", w) != has("after", w) for w in POLYMORPHIC), "abstract-virtual-sealed-changed"),
        ((F.col("before.kind") == "EnumMember") & differs("signature"), "enum-member-value-changed"),
    ]
    if include_attributes:
        facets.append((differs("attributes"), attribute_code))
    rows = sides.withColumn("code", F.explode(reasons(*facets)))
    rows = rows.select(
        *keys, "code", F.lit("change").alias("change"), "doc_id", *[F.col(f"after.{c}").alias(c) for c in SIDE],
        *_evidence("before", "after"),
    )
    return _finish(rows, keys)


def unmatched(base: DataFrame, head: DataFrame, keys=()) -> tuple[DataFrame, DataFrame]:
    """Rows whose id the other side lacks."""
    key = [*keys, "doc_id"]
    return base.join(head.select(*key), key, "left_anti"), head.join(base.select(*key), key, "left_anti")


def _lone(df: DataFrame, side: str, keys) -> DataFrame:
    return df.select(*keys, "doc_id", F.lit(side).alias("__side"), F.struct(*sorted(df.columns)).alias("__row"))


def _paired(lone: DataFrame, keys) -> DataFrame:
    """Rows of one side each, (before, after) by equal kind, container, name, parameter count and place by id; one of the two is null where
    the other side has no such place. Rows without a kind or name are not paired.
    """
    row = F.col("__row")
    shaped = lone.withColumns({"kind": row["kind"], "__container": F.coalesce(row["container"], F.lit("\u0000")), "name": row["name"], "__n": F.size(row["parameters"])})
    shaped = shaped.withColumn("__alone", F.when(F.col("kind").isNull() | F.col("name").isNull() | F.col("__n").isNull(), F.col("__side")))
    shape = [*keys, "kind", "__container", "name", "__n", "__alone"]
    numbered = number_rows(shaped, [*shape, "__side"], "doc_id", "__place")
    of = lambda side: F.first(F.when(F.col("__side") == side, row), ignorenulls=True)
    return numbered.groupBy(*shape, "__place").agg(of("base").alias("before"), of("head").alias("after")).select(*keys, "before", "after")


def _pair_rows(pairs: DataFrame, keys) -> DataFrame:
    return pairs.filter("before is not null and after is not null").select(
        *keys, F.lit("public-signature-changed").alias("code"), F.lit("change").alias("change"), F.col("after.doc_id").alias("doc_id"),
        F.col("before.doc_id").alias("base_id"), *[F.col(f"after.{c}").alias(c) for c in SIDE], *_evidence("before", "after"),
    )


def pair_signature_changes(base_only: DataFrame, head_only: DataFrame, keys=()) -> DataFrame:
    """Unmatched rows of equal kind, container, name and parameter count, paired in id order."""
    return _pair_rows(_paired(_lone(base_only, "base", keys).unionByName(_lone(head_only, "head", keys)), keys), keys)


def _code(removal: bool) -> Column:
    word = "removed" if removal else "added"
    return (
        F.when(F.col("kind") == "NamedType", f"public-type-{word}")
        .when(F.col("kind") == "EnumMember", f"enum-member-{word}")
        .otherwise(f"public-member-{word}")
    )


def removals_additions(base_left: DataFrame, head_left: DataFrame, head: DataFrame, include_additions: bool = True, keys=()) -> DataFrame:
    """What is left after pairing: removals and additions by kind; a member added to an interface is breaking.

    The container of an added member belongs to an interface when its last dotted part is an interface's name.
    """
    place = lambda df: df.select(*[F.struct("path", "line", "column").alias("side")], "*")
    gone = place(base_left).select(
        *keys, _code(True).alias("code"), F.lit("removal").alias("change"), "doc_id", *SIDE, *_evidence("side", None)
    )
    if not include_additions:
        return _finish(gone, keys)
    interfaces = (
        head.filter((F.col("kind") == "NamedType") & F.col("signature").contains("interface"))
        .select(*keys, F.col("name").alias("__type"))
        .distinct()
        .withColumn("__interface", F.lit(True))
    )
    own_type = F.element_at(F.split("container", r"\."), -1)
    added = head_left.withColumn("__type", own_type).join(interfaces, [*keys, "__type"], "left")
    member = (F.col("kind") != "NamedType") & F.coalesce("__interface", F.lit(False))
    added = place(added).select(
        *keys, F.when(member, "interface-member-added").otherwise(_code(False)).alias("code"),
        F.lit("addition").alias("change"), "doc_id", *SIDE, *_evidence(None, "side"),
    )
    return _finish(gone.unionByName(added), keys)


def api_changes(base: DataFrame, head: DataFrame, include_additions=True, include_attributes=True, keys=()) -> DataFrame:
    """All changes between two snapshots that have one row per id.

    One full outer join on (keys, id) tells matched, base-only and head-only rows apart; what only one side has is numbered and paired
    in one grouping. Each of the two results is written once, so neither snapshot is read or joined again.
    """
    side = lambda df, name: df.select(*keys, "doc_id", F.struct(*sorted(df.columns)).alias(name))
    both = cut_lineage(side(base, "before").join(side(head, "after"), [*keys, "doc_id"], "full_outer"))
    lone = both.filter("before is null or after is null")
    one = F.when(F.col("after").isNull(), "base").otherwise("head")
    pairs = cut_lineage(_paired(lone.select(*keys, "doc_id", one.alias("__side"), F.coalesce("before", "after").alias("__row")), keys))
    gone = pairs.filter("after is null").select("before.*")
    new = pairs.filter("before is null").select("after.*")
    present = both.filter("after is not null").select("after.*")
    matched = both.filter("before is not null and after is not null")
    return (
        _facet_changes(matched, include_attributes, keys)
        .unionByName(_finish(_pair_rows(pairs, keys).drop("base_id"), keys))
        .unionByName(removals_additions(gone, new, present, include_additions, keys))
    )


def api_diff(base: DataFrame, head: DataFrame, limit: int, include_additions=True, include_attributes=True, keys=()) -> DataFrame:
    """Changes in risk order, bounded, with evidence of both sides."""
    changes = api_changes(base, head, include_additions, include_attributes, keys)
    return bounded_section(changes, CHANGE_ORDER, limit, keys)


def api_diff_summary(changes: DataFrame, keys=()) -> DataFrame:
    """Totals: changes, source- and binary-breaking, additions, removals, signature changes."""
    return changes.groupBy(*keys).agg(
        F.count("*").alias("total_changes"),
        F.count_if(F.col("source_risk") == "breaking").alias("source_breaking"),
        F.count_if(F.col("binary_risk") == "breaking").alias("binary_breaking"),
        F.count_if(F.col("change") == "addition").alias("additions"),
        F.count_if(F.col("change") == "removal").alias("removals"),
        F.count_if(F.col("code") == "public-signature-changed").alias("signature_changes"),
    )
