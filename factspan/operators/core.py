"""Order, limits, first-of-group, location merging, fingerprints and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

LOC = ["path", "line", "column", "end_line", "end_column"]


def _cols(items) -> list[Column]:
    """Columns of order or group keys; a leading '-' means descending."""
    named = lambda c: F.col(c[1:]).desc() if c.startswith("-") else F.col(c)
    return [named(c) if isinstance(c, str) else c for c in items]


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which two nulls are equal; keeps the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = all_of(left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys)
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def stable_order(df: DataFrame, keys) -> DataFrame:
    """Total deterministic order, nulls first ascending."""
    return df.orderBy(*_cols(keys))


def top_per_group(df: DataFrame, group, order, limit: int, position: str = "position") -> DataFrame:
    """First ``limit`` rows of each group in a total order.

    The rank filter lets Spark keep only ``limit`` rows per group and map task before the shuffle, so a hot
    group never reaches one task whole.
    """
    window = Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
    return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= limit)


#: Rows of one key up to which they are grouped in one task.
HOT = 1 << 20


def deal(df: DataFrame, keys, by, hot: int = HOT) -> DataFrame:
    """Rows with the rows of each key brought together by one exchange; ``__part`` is 0, or a part of the key where keys are large.

    A key of more than ``hot`` rows is dealt over more tasks by a hash of ``by``. Rows are counted per bucket of key hashes: that costs
    the same however many keys there are, and counts no key short.
    """
    keys = list(keys)
    buckets = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 16)).alias("bucket")).agg(F.count("*").alias("n"))
    parts = F.ceil(F.coalesce(buckets.agg(F.max("n").alias("most")).scalar(), F.lit(1)) / F.lit(hot))
    return df.withColumn("__part", F.pmod(F.xxhash64(*by), parts)).repartition(*keys, "__part")


def dedupe_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per composite key, the first in a stated order."""
    return top_per_group(df, keys, order, 1, "__first").drop("__first")


def running_total(df: DataFrame, keys: list[str], order: str, weight: Column, name: str) -> DataFrame:
    """Running sum of a weight in a group's order, for groups of any size. ``order`` is unique within a group.

    Rows are range-partitioned by (keys, order), so a hot group spans many tasks; the partition numbers are pinned
    by a checkpoint, sums run inside each part, and the parts' offsets are a small table joined back.
    """
    ranged = df.withColumn("__w", weight.cast("long")).repartitionByRange(*keys, order)
    parts = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "__part").agg(F.sum("__w").alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn("__local", F.sum("__w").over(inside))
    placed = join_null_safe(summed, offsets, [*keys, "__part"])
    return placed.withColumn(name, F.col("__offset") + F.col("__local")).drop("__part", "__local", "__offset", "__w")


def number_rows(df: DataFrame, keys: list[str], order: str, name: str = "place") -> DataFrame:
    """1-based place of every row in its group, for groups of any size."""
    return running_total(df, keys, order, F.lit(1), name)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles: the least value whose share of rows at or below it reaches q.

    Equal values are counted on the map side and the counts are summed along the order by :func:`running_total`,
    so no group is gathered in one aggregation buffer.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    summed = running_total(counts, keys, value, F.col("__n"), "__upto")
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    joined = join_null_safe(summed, totals, keys) if keys else summed.withColumn("__total", totals.scalar())
    reached = lambda q: F.col("__upto") >= F.ceil(F.col("__total") * F.lit(q))
    return joined.groupBy(*keys).agg(
        *[F.min(F.when(reached(q), F.col(value))).alias(name) for name, q in quantiles.items()]
    )


def bounded_section(df: DataFrame, order, limit: int, group=()) -> DataFrame:
    """First ``limit`` rows per group with the group's ``total`` and whether rows were left out.

    Totals come from a partial aggregate joined back to the few kept rows.
    """
    group = list(group)
    if group:
        kept = top_per_group(df, group, order, limit)
        totals = df.groupBy(*group).agg(F.count("*").alias("total"))
        kept = join_null_safe(kept, totals, group)
    else:
        head = df.orderBy(*_cols(order)).limit(limit)
        window = Window.partitionBy(F.lit(0)).orderBy(*_cols(order))
        head = head.withColumn("position", F.row_number().over(window))
        kept = head.withColumn("total", df.agg(F.count("*").alias("total")).scalar())
    return kept.withColumn("truncated", F.col("total") > limit)


def merge_locations(edges: DataFrame, keys, loc=LOC) -> DataFrame:
    """Distinct locations of each key as rows.

    A key may hold a large share of all rows, so the list stays a child table; :func:`location_heads`
    gives the per-key header with a bounded list.
    """
    return edges.select(*keys, *loc).distinct()


def location_heads(edges: DataFrame, keys, loc=LOC, limit: int = 5) -> DataFrame:
    """Per key: distinct location count, first location, and the first ``limit`` locations in order."""
    rows = merge_locations(edges, keys, loc)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("location_count"))
    heads = (
        top_per_group(rows, keys, loc, limit)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*loc))).alias("first_locations"))
    )
    return join_null_safe(counts, heads, list(keys)).withColumn("first_location", F.col("first_locations")[0])


#: Bytes of lines up to which a group's digest is taken over its joined lines, and digests that one digest of a larger group covers.
PLAIN_BYTES = 8 << 20
RUN = 4096


def fingerprint(df: DataFrame, group, cols, length: int = 64, order=None, head=(), plain_bytes: int = PLAIN_BYTES, run: int = RUN) -> DataFrame:
    """SHA-256 over a group's rows in a fixed order; ``form`` says which of two.

    plain: the digest of the group's lines, joined by line feeds: first the ``head`` columns (alike in all rows of a group), then each
    row's ``cols`` joined by ``|`` with nulls as empty texts, in ``order`` (by default ``cols``), equal ones by line.
    merkle: groups of more than ``plain_bytes``, which no task could hold. Every line's digest gets its place in the order; each
    ``run`` of them by place becomes the digest of their list, and so on up to one root, which is digested below the head lines.
    A list of one is its entry. Either form depends on nothing but the group's rows.
    """
    group, head = list(group), list(head)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws("|", *[text(c) for c in cols])
    key = F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order or cols)], line.alias("line"))
    rows = df.select(*group, *[text(c).alias(f"__h{n}") for n, c in enumerate(head)], key.alias("__key"))
    heads = [f"__h{n}" for n in range(len(head))]
    joined = lambda items: F.array_join(items, "\n")
    size = F.sum(F.octet_length("__key.line").cast("long") + 1)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("row_count"), size.alias("__bytes"), *[F.min(h).alias(h) for h in heads])
    large = cut_lineage(sizes.filter(F.col("__bytes") > plain_bytes))
    most = large.agg(F.max("row_count")).first()[0]
    small = rows if most is None else join_null_safe(rows, large.select(*group), group, "left_anti") if group else rows.limit(0)
    listed = F.transform(F.array_sort(F.collect_list("__key")), lambda k: k["line"])
    plain = small.groupBy(*group).agg(F.count("*").alias("row_count"), joined(listed).alias("__lines"), *[F.min(h).alias(h) for h in heads])
    digest = lambda body: F.substring(F.sha2(F.concat_ws("\n", *heads, body), 256), 1, length).alias("fingerprint")
    out = plain.filter("row_count > 0").select(*group, "row_count", digest(F.col("__lines")), F.lit("plain").alias("form"))
    if most is None:
        return out
    ranked = number_rows(join_null_safe(rows, large.select(*group), group, "left_semi") if group else rows, group, "__key", "__place")
    nodes = ranked.select(*group, (F.col("__place") - 1).alias("__place"), F.sha2("__key.line", 256).alias("__item"))
    while most > 1:
        entries = F.array_sort(F.collect_list(F.struct("__place", "__item")))
        merged = F.when(F.count("*") == 1, F.min("__item")).otherwise(F.sha2(joined(F.transform(entries, lambda e: e["__item"])), 256))
        parents = nodes.withColumn("__parent", F.expr(f"__place div {run}")).groupBy(*group, "__parent")
        nodes = parents.agg(merged.alias("__item")).withColumnRenamed("__parent", "__place")
        most = -(-most // run)
    roots = join_null_safe(nodes.drop("__place"), large, group) if group else nodes.drop("__place").join(large)
    return out.unionByName(roots.select(*group, "row_count", digest(F.col("__item")), F.lit("merkle").alias("form")))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def union_first_wins(a: DataFrame, b: DataFrame, keys, order) -> DataFrame:
    """Rows of ``a``, and the rows of ``b`` whose key ``a`` does not have; one row per key."""
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)))
    return dedupe_first(both, keys, ["__side", *order]).drop("__side")


def difference(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Rows of ``a`` whose key does not occur in ``b``; null keys match null."""
    return join_null_safe(a, b.select(*keys).distinct(), list(keys), "left_anti")


# Items and evidence entries kept by each output profile; None keeps all.
PROFILES = {"compact": (10, 3), "evidence": (50, 5), "full": (None, None)}


def trim_profile(
    df: DataFrame, profile: str, order, group=(), lists=(), snippet_fields=(), snippet_columns=()
) -> DataFrame:
    """Rows and evidence lists cut to an output profile; snippets dropped from all but the full one."""
    items, evidence = PROFILES[profile]
    if items is None:
        return df
    if group:
        df = top_per_group(df, group, order, items).drop("position")
    else:
        df = df.orderBy(*_cols(order)).limit(items)
    for name in lists:
        trimmed = F.slice(name, 1, evidence)
        if snippet_fields:
            trimmed = F.transform(trimmed, lambda x: x.dropFields(*snippet_fields))
        df = df.withColumn(name, trimmed)
    return df.drop(*snippet_columns)
