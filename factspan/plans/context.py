"""What to read first: context packs, diagnostic packs, edit preflights and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import stable_id
from ..functions.paths import lines_of
from ..operators import budget, evals, graph, impact, spans, usage
from ..operators.core import HOT, LOC, deal, join_null_safe, top_per_group
from ..operators.graph import callers_of, calls_of
from ..session import cut_lineage
from . import lookup


def _item(df: DataFrame, kind: str, reason, suffix, *more: str) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return df.select(
        F.col("target_id").alias("pack_id"), stable_id(kind, *LOC, suffix).alias("item_id"), F.lit(kind).alias("kind"),
        F.array(reason).alias("reason_codes"), *LOC, *more,
    )


def query_items(
    chosen: DataFrame, decls: DataFrame, references: DataFrame, call_edges: DataFrame, type_edges: DataFrame, diags: DataFrame,
    item_limit: int | None = None,
) -> DataFrame:
    """Items of a symbol's pack: definition, members, references, related files, callers, calls, implementations, diagnostics.

    Which items come first is known only when all kinds are ranked together (see :func:`context_pack`). Diagnostics of one place and id
    are merged before their file meets the targets. With the ``item_limit`` of the pack only the first files of a target give it
    diagnostics, each its first ones, as many as can come into a pack; ``left_out`` of the last counts the others, so that totals stay true.
    """
    placed = chosen.select("target_id", "symbol_id").join(decls, "symbol_id")
    places = decls.select("symbol_id", *LOC, "name")
    none = F.lit(None).cast("string")
    members = impact.members_of(placed.filter(F.col("kind") == "NamedType"), decls)
    refs = cut_lineage(usage.references_of(chosen, references))
    callable_ = placed.filter(F.col("kind").isin("Method", "Property", "Event")).select("target_id", "symbol_id")

    def at(calls: DataFrame, other: str) -> DataFrame:
        return calls.select("target_id", F.col(other).alias("symbol_id")).distinct().join(places, "symbol_id")

    known = {
        "references": refs, "callers": cut_lineage(callers_of(callable_, call_edges, type_edges)), "calls": cut_lineage(calls_of(callable_, call_edges)),
        "implementations": cut_lineage(graph.implementations_of(chosen, type_edges)),
    }
    callers, calls, implementations = at(known["callers"], "caller_id"), at(known["calls"], "callee_id"), at(known["implementations"], "symbol_id")
    files = cut_lineage(lookup.related(chosen, decls, references, call_edges, type_edges, known=known))
    scope = [df.select("target_id", "path") for df in (placed, refs, files)]
    in_scope = _diagnostics_in_scope(diags, scope, item_limit)
    items = _item(placed, "definition", "selected-symbol-definition", F.col("name"))
    items = items.unionByName(_item(members, "member", "member-outline-entry", F.col("name")))
    items = items.unionByName(_item(refs, "reference", "references-selected-symbol", none))
    items = items.unionByName(_item(files, "related-file", F.get("reasons", 0), none))
    items = items.unionByName(_item(callers, "caller", "caller-of-selected-symbol", F.col("name")))
    items = items.unionByName(_item(calls, "call", "callee-of-selected-symbol", F.col("name")))
    items = items.unionByName(_item(implementations, "implementation", "implements-selected-symbol", F.col("name")))
    items = items.withColumn("message", none).withColumn("left_out", F.lit(0).cast("long"))
    return items.unionByName(_item(in_scope, "diagnostic", "diagnostic-in-context", F.col("id"), "message", "left_out"))


def _diagnostics_in_scope(diags: DataFrame, scope: list[DataFrame], item_limit: int | None) -> DataFrame:
    """Per target the diagnostics of its files; of those of one place and id the one with the least message.

    With a limit a file meets a target as one row with its number of diagnostics. Items go by path, so the first files that hold more than
    ``item_limit`` together give all that can come into a pack: at most ``item_limit`` + 1 each. The last row counts the rest.
    """
    ident = F.coalesce("id", F.lit("")).alias("id")
    merged = diags.filter(F.col("path").isNotNull()).groupBy(*LOC, ident).agg(F.min("message").alias("message"))
    if item_limit is None:
        return spans.diagnostics_for_context(merged.withColumn("left_out", F.lit(0).cast("long")), *scope)
    most = item_limit + 1
    merged = merged.withColumn("item_id", stable_id("diagnostic", *LOC, "id"))
    order = [c for c in budget.ITEM_ORDER if c in merged.columns]
    sizes = merged.groupBy("path").agg(F.count("*").alias("total"))
    heads = cut_lineage(top_per_group(merged, ["path"], order, most).join(sizes, "path").drop("item_id"))
    # Of the sizes' rows each stands for one diagnostic at least, so no more files than items are looked at.
    found = cut_lineage(spans.diagnostics_for_context(heads.filter("position = 1").select("path", "total"), *scope))
    first = top_per_group(found, ["target_id"], ["path"], most, "__at")
    upto = Window.partitionBy("target_id").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumn("__upto", F.sum("total").over(upto)).filter(F.col("__upto") - F.col("total") <= item_limit)
    totals = found.groupBy("target_id").agg(F.sum("total").alias("__all"))
    first = join_null_safe(first, totals, ["target_id"])
    rest = F.when(F.col("__upto") > item_limit, F.col("__all") - F.col("__upto")).otherwise(0)
    rows = first.select("target_id", "path", rest.alias("__rest")).join(heads, "path")
    left_out = F.when(F.col("position") == F.least("total", F.lit(most)), F.col("total") - F.col("position") + F.col("__rest")).otherwise(0)
    return rows.withColumn("left_out", left_out.cast("long")).drop("position", "total", "__rest")


def diff_items(review: dict[str, DataFrame]) -> DataFrame:
    """Items of a change's pack: changed symbols, findings, diagnostics, affected files."""
    named = lambda df: df.withColumn("target_id", F.col("change_id"))
    changed = _item(named(review["symbols"]), "changed-symbol", "changed-symbol", F.col("name"))
    findings = _item(named(review["findings"]), "finding", F.col("code"), F.col("code"))
    diagnostics = _item(named(review["diagnostics"]), "diagnostic", F.col("reason"), F.col("id"))
    files = _item(review["affected"].drop("target_id").transform(named), "diff-impact", F.get("reasons", 0), F.lit(None).cast("string"))
    items = changed.unionByName(findings).unionByName(diagnostics).unionByName(files)
    return items.withColumn("message", F.lit(None).cast("string"))


def context_pack(
    items: DataFrame, documents: DataFrame, goal: str, change_kind: str | None = None, budget_tokens: int = 4000, item_limit: int = 50,
    context_lines: int = 0, hot: int = HOT,
) -> dict[str, DataFrame]:
    """Items in order with their lines, cut to the budget, what was left out, and the sections with their true totals.

    All kinds are ranked together. The items of a pack go through one exchange, which deals large packs (see ``core.deal``); where they lie
    they are ranked, counted by kind and cut to the first ``item_limit`` + 1, and only these have their text fetched. Everything left out is counted.
    """
    if "left_out" not in items.columns:
        items = items.withColumn("left_out", F.lit(0).cast("long"))
    ranked = budget.rank_context(deal(items, ["pack_id"], ["item_id"], hot), goal, change_kind, ["__part"])
    part = Window.partitionBy("pack_id", "__part")
    kind = Window.partitionBy("pack_id", "__part", "kind")
    counted = ranked.withColumn("__items", F.count("*").over(kind) + F.sum("left_out").over(kind))
    counted = counted.withColumn("__of_kind", F.row_number().over(kind.orderBy("item_id")))
    counted = counted.withColumn("__at", F.row_number().over(part.orderBy(*budget.ITEM_ORDER)))
    first = cut_lineage(counted.filter((F.col("__at") <= item_limit + 1) | (F.col("__of_kind") == 1)))
    totals = cut_lineage(first.filter("__of_kind = 1").groupBy("pack_id", "kind", "priority").agg(F.sum("__items").alias("total")))
    entering = first.filter((F.col("__at") <= item_limit + 1) & F.col("pack_id").isNotNull() & F.col("kind").isNotNull())
    entering = entering.drop("left_out", "__part", "__items", "__of_kind", "__at")
    head = top_per_group(entering, ["pack_id"], budget.ITEM_ORDER, item_limit + 1).drop("position")
    lines = budget.snippets(head.filter(F.col("message").isNull() & F.col("path").isNotNull()), documents, context_lines).select("path", "line", "lines")
    filled = head.join(lines, ["path", "line"], "left").withColumn(
        "lines", F.when(F.col("message").isNotNull(), F.array("message")).otherwise(F.col("lines"))
    )
    costed = cut_lineage(budget.with_chars(filled))
    kept = budget.apply_budget(costed, budget_tokens, item_limit)
    summary = budget.budget_summary(costed, budget_tokens, item_limit, totals=totals.groupBy("pack_id").agg(F.sum("total").alias("total_items")))
    included = kept.groupBy("pack_id", "kind").agg(F.count("*").alias("included"))
    sections = totals.select("pack_id", "kind", "total").join(included, ["pack_id", "kind"], "left").fillna(0, ["included"])
    return {
        "items": kept.withColumn("lines", F.when(F.col("has_content"), F.col("lines"))), "summary": summary,
        "sections": sections.withColumn("truncated", F.col("total") > F.col("included")),
    }


def diagnostic_pack(
    points: DataFrame, diags: DataFrame, decls: DataFrame, documents: DataFrame, severities=(), limit: int = 50, max_lines: int = 40, budget_tokens: int = 1000
) -> dict[str, DataFrame]:
    """Diagnostics of each asked id or place, and for the representative one its scopes and source slice."""
    if severities:
        diags = diags.filter(F.col("severity").isin(list(severities)))
    first = cut_lineage(spans.representative(points, diags))
    scopes = spans.scope_stack(first.select("path", F.col("line").alias("at_line")), decls, payload=("symbol_id",))
    own = spans.enclosing_declaration(first.select("target_id", "path", "line"), decls)
    asked = own.filter(F.col("containing_symbol_id").isNotNull()).select("target_id", F.col("containing_symbol_id").alias("symbol_id"))
    slices = budget.source_slices(cut_lineage(asked), decls.withColumn("is_metadata", F.lit(False)), documents, max_lines, budget_tokens)
    return {
        "diagnostics": spans.diagnostics_at(points, diags, limit),
        "representative": first,
        "scopes": first.select("target_id", "path", F.col("line").alias("at_line")).join(scopes, ["path", "at_line"]),
        "slices": slices,
    }


def edit_preflight(
    targets: DataFrame, decls: DataFrame, references: DataFrame, call_edges: DataFrame, type_edges: DataFrame, diags: DataFrame,
    documents: DataFrame, tests: DataFrame, goal: str = "modify", change_kind: str | None = None, budget_tokens: int = 4000,
    item_limit: int = 50, test_limit: int = 20, min_confidence: str = "low",
) -> dict[str, DataFrame]:
    """Choice, source, context, tests and confidence ledger of each target before an edit.

    Intent, hand-off and ledger outputs are selections of these tables.
    """
    found = lookup.find(targets, decls, min_confidence=min_confidence)
    choice = cut_lineage(found["choice"])
    chosen = choice.filter("selected").select("target_id", "symbol_id")
    source = budget.source_slices(chosen, decls.withColumn("is_metadata", F.lit(False)), documents, 80, budget_tokens)
    items = query_items(chosen, decls, references, call_edges, type_edges, diags, item_limit)
    pack = context_pack(items, documents, goal, change_kind, budget_tokens, item_limit)
    subjects = chosen.join(decls.select("symbol_id", "name", "kind", "container"), "symbol_id").withColumnRenamed("target_id", "subject_id")
    refs = usage.references_of(chosen, references).select(F.col("target_id").alias("subject_id"), "path")
    related = cut_lineage(impact.tests_for_subjects(impact.rank_tests(tests, subjects, refs), test_limit))
    status = source.groupBy("target_id").agg(F.min("status").alias("status"))
    context = pack["summary"].select(
        F.col("pack_id").alias("target_id"), F.col("included").alias("item_count"), F.col("omitted_reason").isNotNull().alias("truncated")
    )
    counts = related.groupBy(F.col("subject_id").alias("target_id")).agg(F.max("total").alias("test_count"))
    ledger = evals.confidence_ledger(choice, status, context, counts)
    return {"choice": choice, "source": source, "items": pack["items"], "tests": related, "ledger": ledger}
