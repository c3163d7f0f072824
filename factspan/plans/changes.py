"""What a change touches: symbols, impact, diagnostics, tests, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import is_generated_path, is_source_path
from ..operators import filters, graph, impact, review, spans, usage
from ..operators.core import LOC, bounded_section
from ..session import cut_lineage
from ..sources import diffs


def changed_symbols(
    diff_files: DataFrame, hunks: DataFrame, documents: DataFrame, decls: DataFrame, exclude_generated: bool = False
) -> dict[str, DataFrame]:
    """Symbols around changed lines with their declarations, and source files no symbol was found for."""
    keep = is_source_path("path")
    if exclude_generated:
        keep = keep & ~is_generated_path("path")
    diff_files = diff_files.filter(keep)
    live = hunks.join(diff_files.filter(F.col("status") != "deleted").select("change_id", "path"), ["change_id", "path"], "left_semi")
    # Many later steps start from the hits: they are written once.
    hits = cut_lineage(spans.changed_declarations(live, decls))
    rows = spans.changed_symbol_rows(hits)
    return {
        "symbols": cut_lineage(rows.join(decls.drop("path"), "symbol_id")),
        "unresolved": spans.unresolved_changes(diff_files, hunks, documents, hits),
    }


def changed_symbols_of_text(diff_text: DataFrame, untracked: DataFrame | None, documents: DataFrame, decls: DataFrame) -> dict[str, DataFrame]:
    """The same from unified-diff text and untracked files."""
    files, hunks = diffs.parse_diff_files(diff_text), diffs.parse_diff_hunks(diff_text)
    if untracked is not None:
        files, hunks = diffs.with_untracked(files, hunks, untracked)
    return changed_symbols(files, hunks, documents, decls)


def impact_evidence(changed: DataFrame, decls: DataFrame, references: DataFrame, call_edges: DataFrame, type_edges: DataFrame) -> dict[str, DataFrame]:
    """Evidence rows of the files each changed symbol affects, and its callers.

    A symbol changed by several changes is looked up once; its evidence is joined back to the changes.
    """
    symbols = changed.select("symbol_id").distinct().withColumn("target_id", F.col("symbol_id"))
    places = decls.select("symbol_id", *LOC)

    def located(df: DataFrame, other: str, reason: str) -> DataFrame:
        found = df.select("target_id", F.col(other).alias("symbol_id")).distinct().join(places, "symbol_id")
        return usage.file_evidence(found, reason, False)

    callers = cut_lineage(graph.callers_of(symbols, call_edges, type_edges))
    evidence = usage.file_evidence(symbols.join(places, "symbol_id"), "contains-changed-symbol", True)
    evidence = evidence.unionByName(usage.file_evidence(usage.references_of(symbols, references), "references-changed-symbol", True))
    evidence = evidence.unionByName(located(callers, "caller_id", "caller-of-changed-symbol"))
    evidence = evidence.unionByName(located(graph.calls_of(symbols, call_edges), "callee_id", "callee-of-changed-symbol"))
    evidence = evidence.unionByName(located(graph.implementations_of(symbols, type_edges), "symbol_id", "implements-changed-symbol"))
    return {"evidence": evidence, "callers": callers}


def impact_diff(changed: DataFrame, decls: DataFrame, references: DataFrame, call_edges: DataFrame, type_edges: DataFrame) -> DataFrame:
    """Affected files per changed symbol: level, reasons, places."""
    found = impact_evidence(changed, decls, references, call_edges, type_edges)
    files = usage.affected_files(found["evidence"])
    return changed.select("change_id", F.col("symbol_id").alias("target_id")).distinct().join(files, "target_id")


def diagnostics_diff(diff_files: DataFrame, affected: DataFrame, diags: DataFrame, documents: DataFrame) -> DataFrame:
    """Diagnostics in changed or affected files of each change, or in their projects, with the way they came in."""
    scope = usage.diagnostics_scope(diff_files.filter(is_source_path("path")), affected.select("change_id", "path").distinct())
    return spans.diagnostics_in_scope(diags, scope, documents, ["change_id"])


def review_diff(
    diff_files: DataFrame, hunks: DataFrame, documents: DataFrame, decls: DataFrame, references: DataFrame, call_edges: DataFrame,
    type_edges: DataFrame, diags: DataFrame,
) -> dict[str, DataFrame]:
    """Changed symbols, affected files, diagnostics in scope, public changes and findings of each change."""
    changed = changed_symbols(diff_files, hunks, documents, decls)
    symbols = changed["symbols"]
    found = impact_evidence(symbols, decls, references, call_edges, type_edges)
    files = usage.affected_files(found["evidence"])
    affected = cut_lineage(symbols.select("change_id", F.col("symbol_id").alias("target_id")).distinct().join(files, "target_id"))
    in_scope = cut_lineage(diagnostics_diff(diff_files, affected, diags, documents))
    public = filters.public_contract_changes(symbols)
    calls = found["callers"].select(
        F.col("target_id").alias("symbol_id"), F.col("path").alias("call_path"), F.col("line").alias("call_line"), F.col("column").alias("call_column")
    )
    callers = symbols.select("change_id", "symbol_id").distinct().join(calls, "symbol_id")
    findings = review.review_findings(in_scope, public, symbols, callers)
    return {**changed, "affected": affected, "diagnostics": in_scope, "public_changes": public, "findings": findings}


def related_tests(changed: DataFrame, tests: DataFrame, references: DataFrame, limit: int = 50) -> DataFrame:
    """Best tests per change over all its changed symbols."""
    subjects = changed.select(F.col("symbol_id").alias("subject_id"), "name", "kind", "container").distinct()
    refs = references.join(changed.select(F.col("symbol_id").alias("target_symbol_id")).distinct(), "target_symbol_id", "left_semi")
    refs = refs.select(F.col("target_symbol_id").alias("subject_id"), "path")
    ranked = impact.rank_tests(tests, subjects, refs)
    best = impact.best_test_per_change(ranked, changed.select("change_id", F.col("symbol_id").alias("subject_id")).distinct())
    return bounded_section(best, impact.TEST_ORDER, limit, ["change_id"])


def review_pack(findings: list[DataFrame], limit: int, scope_files: DataFrame | None = None) -> dict[str, DataFrame]:
    """Findings of the chosen packs, in the changed files only when a scope is given; kept in order, and their summary.

    The summary counts all findings; ``kept_summary`` those that the limit kept.
    """
    union = findings[0]
    for part in findings[1:]:
        union = union.unionByName(part)
    if scope_files is not None:
        union = union.join(scope_files.filter(is_source_path("path")).select("path").distinct(), "path", "left_semi")
    kept = review.order_findings(union, limit)
    return {"findings": kept, "summary": review.finding_summary(union), "kept_summary": review.finding_summary(kept)}
