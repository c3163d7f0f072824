"""Finding and resolving targets, and what depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import chains, graph, impact, ranking, spans, usage
from ..operators.core import LOC, bounded_section
from ..session import cut_lineage


def find(targets: DataFrame, decls: DataFrame, limit: int = 20, min_confidence: str = "low") -> dict[str, DataFrame]:
    """Candidates in order, the choice, why it is ambiguous where it is, and the targets whose pattern is invalid.

    A name that many declarations share is reduced to its count and its first rows before it meets the targets.
    """
    matched = cut_lineage(ranking.match_names(targets, decls, with_regex=True))
    choice = ranking.select_candidate(ranking.rank_matches(matched, ranking.name_groups(decls)), targets, min_confidence)
    heads = ranking.rank_matches(matched, ranking.name_heads(decls, limit))
    return {"choice": choice, "candidates": ranking.find_result(heads, choice, limit), "invalid": ranking.invalid_patterns(targets)}


def resolve_positions(points: DataFrame, identifiers: DataFrame, decls: DataFrame) -> DataFrame:
    """The symbol under each position; a position gives one candidate, so confidence is high or none."""
    found = spans.symbol_at(points, identifiers, decls)
    confidence = F.when(F.col("status") == "ok", "high").otherwise("none")
    return found.withColumn("confidence", confidence)


def where_used(
    chosen: DataFrame, references: DataFrame, decls: DataFrame, dimensions: dict[str, str], limit: int = 50, file_limit: int = 20
) -> dict[str, DataFrame]:
    """References of chosen targets (or of every candidate when ambiguous): places, counts, groups and files."""
    refs = usage.references_of(chosen, references)
    refs = spans.enclosing_declaration(refs, decls)
    return {
        "references": bounded_section(refs, [*LOC], limit, ["target_id"]),
        "counts": usage.usage_counts(refs),
        "groups": usage.grouped_usage(refs, dimensions),
        "files": usage.files_by_references(refs, file_limit),
    }


def about(
    chosen: DataFrame, decls: DataFrame, references: DataFrame, call_edges: DataFrame, type_edges: DataFrame,
    limit: int = 20, light: bool = False,
) -> dict[str, DataFrame]:
    """Definition, members, references and relations of each target; the light profile leaves the last two out.

    Every section but the definition is cut to its first rows and carries its total.
    """
    placed = chosen.select("target_id", "symbol_id").join(decls, "symbol_id")
    members = impact.members_of(placed.filter(F.col("kind") == "NamedType"), decls)
    result = {"definition": placed, "members": bounded_section(members, ["line", "column", "symbol_id"], limit, ["target_id"])}
    if light:
        return result
    callable_ = placed.filter(F.col("kind").isin("Method", "Property", "Event")).select("target_id", "symbol_id")
    callers = usage_heads(graph.callers_of(callable_, call_edges, type_edges), "caller_id", limit)
    calls = usage_heads(graph.calls_of(callable_, call_edges, decls), "callee_id", limit)
    result["references"] = bounded_section(usage.references_of(chosen, references), [*LOC], limit, ["target_id"])
    result["callers"], result["calls"] = callers, calls
    implementations, hierarchy = graph.implementations_of(chosen, type_edges), graph.type_hierarchy(chosen, type_edges)
    result["implementations"] = bounded_section(implementations, ["depth", "symbol_id"], limit, ["target_id"])
    result["hierarchy"] = bounded_section(hierarchy, ["depth", "symbol_id"], limit, ["target_id", "relation"])
    return result


def usage_heads(calls: DataFrame, other: str, limit: int) -> DataFrame:
    return bounded_section(graph.call_groups(calls, other), [*LOC, other], limit, ["target_id"])


def related(
    chosen: DataFrame, decls: DataFrame, references: DataFrame, call_edges: DataFrame, type_edges: DataFrame,
    include=("declarations", "references", "callers", "calls", "implementations", "hierarchy"), impact_levels: bool = False, limit: int | None = None,
    known: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Files related to each target; with ``impact_levels`` each file is direct or indirect.

    ``known`` holds the parts of ``include`` that the caller has found already, as their operators return them.
    """
    known = known or {}
    direct = True if impact_levels else None
    indirect = False if impact_levels else None
    placed = chosen.select("target_id", "symbol_id").join(decls, "symbol_id")
    places = decls.select("symbol_id", *LOC)
    callable_ = placed.filter(F.col("kind").isin("Method", "Property", "Event")).select("target_id", "symbol_id")
    parts = []
    if "declarations" in include:
        parts.append(usage.file_evidence(placed, "declares-selected-symbol", direct))
    if "references" in include:
        refs = known["references"] if "references" in known else usage.references_of(chosen, references)
        parts.append(usage.file_evidence(refs, "references-selected-symbol", direct))
    if "callers" in include:
        callers = known["callers"] if "callers" in known else graph.callers_of(callable_, call_edges, type_edges)
        parts.append(usage.file_evidence(callers, "caller-of-selected-member", direct))
    if "calls" in include:
        calls = known["calls"] if "calls" in known else graph.calls_of(callable_, call_edges)
        callees = calls.select("target_id", F.col("callee_id").alias("symbol_id")).distinct()
        parts.append(usage.file_evidence(callees.join(places, "symbol_id"), "callee-of-selected-member", indirect))
    if "implementations" in include:
        found = known["implementations"] if "implementations" in known else graph.implementations_of(chosen, type_edges)
        parts.append(usage.file_evidence(found.join(places, "symbol_id"), "implements-selected-symbol", indirect))
    if "hierarchy" in include:
        found = graph.type_hierarchy(chosen, type_edges, ("derived-type", "implementing-type"))
        parts.append(usage.file_evidence(found.join(places, "symbol_id"), "hierarchy-related-symbol", indirect))
    evidence = parts[0]
    for part in parts[1:]:
        evidence = evidence.unionByName(part)
    return usage.related_files(evidence, limit)


def entrypoints(
    chosen: DataFrame, decls: DataFrame, call_edges: DataFrame, framework_entrypoints: DataFrame, depth: int = 3, limit: int = 20
) -> DataFrame:
    """Caller chains of callable targets, marked where they end at a framework entrypoint."""
    callable_ = decls.filter(F.col("kind").isin("Method", "Property", "Event")).select("symbol_id")
    asked = chosen.join(callable_, "symbol_id", "left_semi")
    places = decls.select("symbol_id", "path", "line", "column")
    return chains.annotate_chains(chains.upstream_chains(asked, call_edges, places, depth, limit), framework_entrypoints)
