"""Repository graphs, snapshot comparison, workspace overviews, symbol and diagnostic lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import filters, snapshots
from ..operators.core import LOC, bounded_section
from ..sources import documents, projects


def repo_graph(project_files: DataFrame, config_files: DataFrame) -> dict[str, DataFrame]:
    """Classified projects, references with versions, edges, test relationships, build-file coverage."""
    found = projects.read_projects(project_files)
    own = projects.read_package_refs(project_files).withColumn(
        "project_id", F.concat(F.lit("project:"), "path", F.lit(":"))
    )
    refs = projects.read_project_refs(project_files)
    packages = projects.inherit_central_versions(own, projects.read_central_versions(config_files))
    classes = filters.classify_projects(found, packages)
    edges = projects.project_edges(found, refs)
    return {
        "projects": classes,
        "packages": packages,
        "edges": edges,
        "test_relationships": projects.test_relationships(edges, classes),
        "coverage": projects.config_file_coverage(config_files, found),
        "central": projects.central_management(config_files),
    }


def public_api_diff(
    base: DataFrame, head: DataFrame, limit: int = 200, include_additions: bool = True, include_attributes: bool = True, keys=()
) -> dict[str, DataFrame]:
    """Changes between two API snapshots in risk order, and their totals. Symbols are those of the scoped files."""
    left, right = snapshots.api_snapshot(base, keys=keys), snapshots.api_snapshot(head, keys=keys)
    changes = snapshots.api_changes(left, right, include_additions, include_attributes, keys)
    return {
        "changes": bounded_section(changes, snapshots.CHANGE_ORDER, limit, keys),
        "summary": snapshots.api_diff_summary(changes, keys),
    }


def snapshot_scope(files: DataFrame, ref: str, scope_projects: DataFrame | None, exclude_generated: bool = True) -> DataFrame:
    """Source files of one snapshot below the chosen projects."""
    return filters.scope_to_projects(documents.snapshot_files(files, ref, exclude_generated), scope_projects)


def symbols(decls: DataFrame, projects_: DataFrame | None, name: str, mode: str = "contains", limit: int = 200, **facets) -> DataFrame:
    """Declarations by project, name and facets, in place order, bounded."""
    found = filters.search_declarations(decls, filters.name_matches("name", name, mode), projects_)
    found = filters.filter_declarations(found, **facets)
    return bounded_section(found, ["path", "line", "column", "name", "symbol_id"], limit)


def diagnostics(diags: DataFrame, projects_: DataFrame | None, severities=(), ids=(), exclude_generated: bool = True, limit: int = 200) -> DataFrame:
    found = filters.filter_diagnostics(diags, severities, ids, exclude_generated)
    if projects_ is not None:
        found = found.join(projects_.select("project").distinct(), "project", "left_semi")
    return bounded_section(found, ["project", *LOC, "severity", "id", "message"], limit)


def overview(docs: DataFrame, cached: DataFrame) -> DataFrame:
    """Per workspace: document statistics, fingerprint and the state of its cache."""
    stats = documents.document_stats(docs)
    prints = documents.workspace_fingerprints(docs).select("repo", "fingerprint")
    current = prints.withColumn("schema_version", F.lit(documents.SCHEMA_VERSION)).withColumn("path", F.col("repo"))
    status = documents.manifest_status(current, cached)
    return stats.join(prints, "repo").join(status, "repo")
