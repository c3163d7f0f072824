"""Position and interval joins.

A span [lo, hi] is filed under the smallest power of sixteen that is at least its length, which makes it touch at
most two cells of that width; a point looks into one cell of each width that spans have. The equi-join key is then (keys, width, cell),
so neither a long span nor a crowded document multiplies rows, and one document is spread over many tasks. Points
and spans are made distinct before the join and the answer is joined back to the rows that asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import is_source_path
from .core import HOT, LOC, all_of, deal, dedupe_first, top_per_group

LEVELS = 8  # widths 16^0 .. 16^7 cover every 32-bit line number


def _level(lo: Column, hi: Column) -> Column:
    length = hi - lo + 1
    level = F.lit(LEVELS)
    for n in range(LEVELS - 1, -1, -1):
        level = F.when(length <= 16**n, n).otherwise(level)
    return level


def _width(level: Column) -> Column:
    return F.pow(F.lit(16), level).cast("long")


def _cell(position: Column, level: Column) -> Column:
    return F.floor(position / _width(level)).cast("long")


def _probing(points: DataFrame, levels: DataFrame, point: str) -> DataFrame:
    """Points with the cells they look into: one for each width that spans have, mostly two or three of the nine."""
    used = levels.agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("level"))).alias("used"))
    wanted = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda n: F.call_function("shiftright", F.col("__used"), n).bitwiseAND(1) == 1)
    probing = points.withColumn("__used", used.scalar()).withColumn("__level", F.explode(wanted)).drop("__used")
    return probing.withColumn("__cell", _cell(F.col(point), F.col("__level")))


def stab(points: DataFrame, spans: DataFrame, keys: list[str], point: str, lo: str, hi: str) -> DataFrame:
    """All (point row, span row) pairs with equal keys and lo <= point <= hi.

    Column names other than the keys must differ between the two inputs.
    """
    level = _level(F.col(lo), F.col(hi))
    filed = (
        spans.filter(F.col(lo) <= F.col(hi))
        .withColumn("__level", level)
        .withColumn(
            "__cell",
            F.explode(F.array_distinct(F.array(_cell(F.col(lo), F.col("__level")), _cell(F.col(hi), F.col("__level"))))),
        )
    )
    joined = _probing(points, spans.filter(F.col(lo) <= F.col(hi)).select(level.alias("level")), point).join(filed, [*keys, "__level", "__cell"])
    inside = (F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))
    return joined.filter(inside).drop("__level", "__cell")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span, right_span) -> DataFrame:
    """All pairs of rows with equal keys whose closed spans meet.

    Two spans meet when one starts inside the other: the left start in the right span, or else the right start
    inside the left span after its first position. The two cases are disjoint, so nothing is counted twice.
    """
    (ls, le), (rs, re) = left_span, right_span
    names = left.columns + [c for c in right.columns if c not in keys]
    starts_in_right = stab(left, right, keys, ls, rs, re).filter(F.col(ls) <= F.col(le))
    starts_in_left = stab(right, left, keys, rs, ls, le).filter((F.col(rs) > F.col(ls)) & (F.col(rs) <= F.col(re)))
    return starts_in_right.select(*names).unionByName(starts_in_left.select(*names))


def innermost(points: DataFrame, spans: DataFrame, keys, point, lo, hi, tie, payload) -> DataFrame:
    """For each distinct (keys, point) the shortest span around it; ties by ``tie``. Inner: misses give no row."""
    wanted = points.select(*keys, point).distinct()
    # Equal spans cannot differ in length: keep the best of each before the join.
    spans = dedupe_first(spans, [*keys, lo, hi], list(tie))
    spans = spans.select(*keys, lo, hi, *[c for c in dict.fromkeys([*tie, *payload]) if c not in (*keys, lo, hi)])
    pairs = stab(wanted, spans, list(keys), point, lo, hi)
    best = F.min(F.struct((F.col(hi) - F.col(lo)).alias("len"), *[F.col(t) for t in tie], *[F.col(p) for p in payload if p not in tie]))
    grouped = pairs.groupBy(*keys, point).agg(best.alias("__best"))
    return grouped.select(*keys, point, *[F.col(f"__best.{p}").alias(p) for p in payload])


def enclosing_declaration(points: DataFrame, decls: DataFrame, keys=("path",), line="line", payload=("symbol_id",)) -> DataFrame:
    """Points with the innermost declaration around their line; null where there is none."""
    keys = list(keys)
    spans = decls.select(*keys, F.col("line").alias("__lo"), F.col("end_line").alias("__hi"), *payload)
    found = innermost(points, spans, keys, line, "__lo", "__hi", list(payload), list(payload))
    found = found.select(*keys, line, *[F.col(p).alias(f"containing_{p}") for p in payload])
    return points.join(found, [*keys, line], "left")


def changed_lines(hunks: DataFrame) -> DataFrame:
    """New-side lines of hunks, distinct per change and path."""
    lines = F.sequence(F.col("new_start"), F.col("new_start") + F.col("new_count") - 1)
    exploded = hunks.filter(F.col("new_count") > 0).withColumn("changed_line", F.explode(lines))
    return exploded.filter(F.col("changed_line") >= 1).select("change_id", "path", "changed_line").distinct()


def changed_declarations(hunks: DataFrame, decls: DataFrame) -> DataFrame:
    """Changed lines with the smallest declaration that contains each: (change, symbol, change kind, line)."""
    lines = changed_lines(hunks)
    spans = decls.select("path", F.col("line").alias("__lo"), F.col("end_line").alias("__hi"), "symbol_id", "kind")
    hits = innermost(lines, spans, ["path"], "changed_line", "__lo", "__hi", ["symbol_id"], ["symbol_id", "kind"])
    kind = F.when(F.col("kind") == "NamedType", "type-body").otherwise("body")
    return lines.join(hits, ["path", "changed_line"]).select(
        "change_id", "symbol_id", "path", kind.alias("change_kind"), "changed_line"
    )


def changed_symbol_rows(hits: DataFrame, line_limit: int = 25, hot: int = HOT) -> DataFrame:
    """Per changed symbol: distinct change kinds, distinct line count, and the first lines.

    Hits go through one exchange by symbol, which deals large symbols by line (see ``core.deal``); each part gives one row with a short list.
    """
    keys = ["change_id", "symbol_id", "path"]
    hits = hits.filter(all_of(F.col(c).isNotNull() for c in keys)).select(*keys, "changed_line", "change_kind")
    lines = deal(hits, keys, ["changed_line"], hot).groupBy(*keys, "__part", "changed_line").agg(F.collect_set("change_kind").alias("__kinds"))
    part = Window.partitionBy(*keys, "__part").orderBy("changed_line")
    lines = lines.withColumn("__at", F.row_number().over(part))
    of_parts = lines.groupBy(*keys, "__part").agg(
        F.count("*").alias("__n"), F.collect_list(F.when(F.col("__at") <= line_limit, F.col("changed_line"))).alias("__lines"),
        F.array_distinct(F.flatten(F.collect_set("__kinds"))).alias("__kinds"),
    )
    symbols = of_parts.groupBy(*keys).agg(
        F.sum("__n").alias("total_lines"), F.flatten(F.collect_list("__lines")).alias("__lines"), F.flatten(F.collect_list("__kinds")).alias("__kinds")
    )
    return symbols.select(
        *keys, "total_lines", F.slice(F.sort_array("__lines"), 1, line_limit).alias("changed_lines"),
        F.sort_array(F.array_distinct("__kinds")).alias("change_kinds"), (F.col("total_lines") > line_limit).alias("lines_truncated"),
    )


def unresolved_changes(diff_files: DataFrame, hunks: DataFrame, documents: DataFrame, hits: DataFrame) -> DataFrame:
    """Changed source files without a symbol hit, and why."""
    key = ["change_id", "path"]
    live = hunks.filter(F.col("new_count") > 0).select(*key).distinct().withColumn("__live", F.lit(True))
    known = documents.select("path").distinct().withColumn("__known", F.lit(True))
    sources = diff_files.filter(is_source_path("path"))
    missing = sources.join(hits.select(*key).distinct(), key, "left_anti")
    gone = (F.col("status") == "deleted") | F.col("__live").isNull()
    reason = (
        F.when(gone, "deleted-or-not-in-current-workspace")
        .when(F.col("__known").isNull(), "source-file-not-in-current-workspace")
        .otherwise("no-source-symbol-overlaps-diff-hunk")
    )
    return missing.join(live, key, "left").join(known, "path", "left").select(*key, "status", reason.alias("reason"))


def diagnostics_in_span(targets: DataFrame, decls: DataFrame, diags: DataFrame, keys=("path",)) -> DataFrame:
    """Diagnostics that meet any declaration span of the target; a missing end line is the start line."""
    keys = list(keys)
    spans = targets.join(decls, "symbol_id").select(
        *keys, "target_id", F.col("line").alias("__lo"), F.col("end_line").alias("__hi")
    )
    ranged = diags.filter(F.col("line").isNotNull()).withColumn("__end", F.coalesce("end_line", "line"))
    pairs = overlaps(ranged, spans.distinct(), keys, ("line", "__end"), ("__lo", "__hi"))
    return pairs.select("target_id", *diags.columns).distinct()


DIAGNOSTIC_ORDER = ["path", "line", "column", "project", "id", "severity", "message"]


def _questions(points: DataFrame, diags: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points numbered by their question, and the diagnostics that answer each distinct question.

    Many points may ask for one id or place: it is looked up once.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ("diagnostic_id", *keys, "at_line")]
    by_id = F.col("diagnostic_id").isNotNull()
    named = points.withColumn(
        "question", F.when(by_id, F.concat(F.lit("id:"), "diagnostic_id")).otherwise(F.concat_ws("\u001f", *parts))
    )
    asked = named.select("question", "diagnostic_id", *keys, "at_line")
    ids = asked.filter(by_id).select("question", F.col("diagnostic_id").alias("id")).distinct()
    places = asked.filter(~by_id).select("question", *keys, "at_line").distinct()
    ranged = diags.filter(F.col("line").isNotNull()).withColumn("__end", F.coalesce("end_line", "line"))
    hits = ids.join(diags, "id").select("question", *diags.columns)
    located = stab(places, ranged, keys, "at_line", "line", "__end").select("question", *diags.columns)
    return named.select("target_id", "question"), hits.unionByName(located)


def diagnostics_at(points: DataFrame, diags: DataFrame, limit: int, keys=("path",)) -> DataFrame:
    """First diagnostics by id, or at a line inside the diagnostic, with the total.

    ``points`` has target_id and (diagnostic_id | keys, at_line).
    """
    asked, hits = _questions(points, diags, list(keys))
    tie = [c for c in diags.columns if c not in DIAGNOSTIC_ORDER]
    kept = top_per_group(hits, ["question"], [*DIAGNOSTIC_ORDER, *tie], limit)
    totals = hits.groupBy("question").agg(F.count("*").alias("total"))
    rows = kept.join(totals, "question").withColumn("truncated", F.col("total") > limit)
    return asked.join(rows, "question").drop("question")


def representative(points: DataFrame, diags: DataFrame, keys=("path",)) -> DataFrame:
    """Per target the first diagnostic at its id or place that has a place itself."""
    placed = diags.filter(all_of(F.col(c).isNotNull() for c in ("path", "line", "column")))
    asked, hits = _questions(points, placed, list(keys))
    first = dedupe_first(hits, ["question"], DIAGNOSTIC_ORDER)
    return asked.join(first, "question").drop("question")


def diagnostics_in_scope(diags: DataFrame, scope_paths: DataFrame, documents: DataFrame, keys=()) -> DataFrame:
    """Diagnostics on scoped paths, and path-less ones of a project that has a scoped document; per ``keys`` of the scope."""
    keys = list(keys)
    scope = scope_paths.select(*keys, "path").distinct()
    on_path = scope.join(diags, "path").withColumn("reason", F.lit("diagnostic-in-diff-scope"))
    touched = scope.join(documents.select("project", "path").distinct(), "path").select(*keys, "project").distinct()
    of_project = touched.join(diags.filter(F.col("path").isNull()), "project").withColumn(
        "reason", F.lit("project-diagnostic-in-touched-project")
    )
    columns = [*keys, *diags.columns, "reason"]
    return on_path.select(*columns).unionByName(of_project.select(*columns))


def diagnostics_for_context(diags: DataFrame, *paths: DataFrame, limit: int | None = None) -> DataFrame:
    """Per target the diagnostics in the union of its definition, reference and related-file paths.

    With a limit the first ones by place; a crowded file is cut to as many before it meets the targets.
    """
    scope = paths[0].select("target_id", "path")
    for more in paths[1:]:
        scope = scope.unionByName(more.select("target_id", "path"))
    scope = scope.distinct()
    if limit is None:
        return scope.join(diags, "path").select("target_id", *diags.columns)
    order = [*DIAGNOSTIC_ORDER, *[c for c in diags.columns if c not in DIAGNOSTIC_ORDER]]
    heads = top_per_group(diags.filter(F.col("path").isNotNull()), ["path"], order, limit).drop("position")
    found = scope.join(heads, "path").select("target_id", *diags.columns)
    return top_per_group(found, ["target_id"], order, limit).drop("position")


def symbols_in_range(ranges: DataFrame, identifiers: DataFrame, line_lengths: DataFrame) -> DataFrame:
    """Distinct symbols whose identifier overlaps a half-open column range of one line.

    ``ranges(target_id, path, line, start_column?, end_column?)``: both columns absent mean the whole line. A
    range outside the line or with one bound only gives one row with status 'invalid-range'.
    """
    sized = ranges.join(line_lengths.select("path", "line", "length"), ["path", "line"], "left")
    whole = F.col("start_column").isNull() & F.col("end_column").isNull()
    start = F.when(whole, F.lit(1)).otherwise(F.col("start_column"))
    end = F.when(whole, F.col("length") + 1).otherwise(F.col("end_column"))
    sized = sized.withColumn("__s", start).withColumn("__e", end)
    good = F.coalesce(
        F.col("length").isNotNull() & (F.col("__s") >= 1) & (F.col("__e") >= F.col("__s")) & (F.col("__e") <= F.col("length") + 1),
        F.lit(False),
    )
    valid = sized.filter(good).select("target_id", "path", "line", "__s", (F.col("__e") - 1).alias("__last"))
    ids = identifiers.select(
        "path", "line", "symbol_id", F.col("column").alias("__c"), (F.col("end_column") - 1).alias("__cl")
    )
    hits = overlaps(ids, valid, ["path", "line"], ("__c", "__cl"), ("__s", "__last"))
    found = hits.select("target_id", "symbol_id", F.lit("ok").alias("status")).distinct()
    bad = sized.filter(~good).select("target_id", F.lit(None).cast("string").alias("symbol_id"), F.lit("invalid-range").alias("status"))
    return found.unionByName(bad)


def scope_stack(points: DataFrame, spans: DataFrame, keys=("path",), point="at_line", lo="line", hi="end_line", payload=("name",)) -> DataFrame:
    """All distinct spans around each distinct position with their depth, outermost = 1."""
    keys = list(keys)
    around = stab(
        points.select(*keys, point).distinct(), spans.select(*keys, lo, hi, *payload).distinct(), keys, point, lo, hi
    )
    # A group is the nesting around one position: positions are distinct, so no position is heavier for being asked often.
    order = [F.col(lo).asc(), F.col(hi).desc(), *[F.col(p) for p in payload]]
    return around.withColumn("depth", F.row_number().over(Window.partitionBy(*keys, point).orderBy(*order)))


def symbol_at(points: DataFrame, identifiers: DataFrame, decls: DataFrame) -> DataFrame:
    """Symbol under a position and its best definition location (same file first); 'not-found' otherwise."""
    ids = identifiers.select(
        "path", "line", F.col("symbol_id").alias("hit_symbol"), F.col("column").alias("__lo"), (F.col("end_column") - 1).alias("__hi")
    )
    under = innermost(points, ids, ["path", "line"], "column", "__lo", "__hi", ["hit_symbol"], ["hit_symbol"])
    asked = points.join(under, ["path", "line", "column"], "left")
    # The best place is the symbol's first in the same file, else its first anywhere: two small tables, no pairs.
    place = F.min(F.struct(*[F.col(c).alias(f"def_{c}") for c in LOC]))
    named = decls.withColumnRenamed("symbol_id", "hit_symbol")
    here = named.groupBy("hit_symbol", "path").agg(place.alias("here"))
    anywhere = named.groupBy("hit_symbol").agg(place.alias("anywhere"))
    best = asked.join(here, ["hit_symbol", "path"], "left").join(anywhere, "hit_symbol", "left")
    status = F.when(F.col("hit_symbol").isNull(), "not-found").otherwise("ok")
    best = best.withColumn("best", F.coalesce("here", "anywhere")).withColumn("status", status)
    return best.select(*points.columns, "hit_symbol", "status", *[F.col(f"best.def_{c}").alias(f"def_{c}") for c in LOC])
