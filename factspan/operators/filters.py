"""Filters and classifications of declarations, projects, locations, diagnostics and API symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import short_attribute
from ..functions.paths import ancestor_dirs, directory, forward_slashes, is_generated_path
from ..functions.ranks import PROJECT_REASONS, ordered_reasons, reasons
from .core import any_of
from .graph import closure


def name_matches(name, query: str, mode: str = "contains", case_sensitive: bool = False) -> Column:
    """Exact, contains or regex match of a name; an invalid pattern raises when the query runs."""
    name = F.col(name) if isinstance(name, str) else name
    if mode == "regex":
        matched = name.rlike(query if case_sensitive else f"(?i){query}")
    else:
        if not case_sensitive:
            name, query = F.lower(name), query.lower()
        matched = name == query if mode == "exact" else name.contains(query)
    return F.coalesce(matched, F.lit(False))


def name_filter(df: DataFrame, query: str, mode: str = "contains", case_sensitive: bool = False, name: str = "name") -> DataFrame:
    return df.filter(name_matches(name, query, mode, case_sensitive))


def search_declarations(decls: DataFrame, name: Column, projects: DataFrame | None = None, exclude_generated: bool = True) -> DataFrame:
    """Declarations of the chosen projects whose name matches, generated files left out."""
    found = decls.filter(name)
    if exclude_generated:
        found = found.filter(~is_generated_path("path"))
    if projects is not None:
        found = found.join(projects.select("project").distinct(), "project", "left_semi")
    return found


def filter_declarations(
    decls: DataFrame, kinds=(), namespaces=(), containers=(), accessibilities=(), mode="contains", case_sensitive=False
) -> DataFrame:
    """AND over facets, OR inside a facet; an empty facet passes, null never matches a text facet."""
    for column, values in (("kind", kinds), ("accessibility", accessibilities)):
        if values:
            decls = decls.filter(F.col(column).isin(list(values)))
    for column, values in (("namespace", namespaces), ("container", containers)):
        if values:
            decls = decls.filter(any_of(name_matches(column, v, mode, case_sensitive) for v in values))
    return decls


def filter_locations(df: DataFrame, path_fragments=(), kinds=(), documents: DataFrame | None = None, kind="usage_kind") -> DataFrame:
    """Locations with any path fragment, a listed kind, and a path among the chosen documents."""
    if path_fragments:
        path = forward_slashes("path")
        df = df.filter(any_of(path.contains(f.replace("\\", "/")) for f in path_fragments))
    if kinds:
        df = df.filter(F.col(kind).isin(list(kinds)))
    if documents is not None:
        df = df.join(documents.select("path").distinct(), "path", "left_semi")
    return df


# Packages that tell a project's purpose (lower case) and the reason they give.
PACKAGE_REASONS = {
    "microsoft.net.test.sdk": "test-sdk-package",
    "xunit": "xunit-package",
    "xunit.v3": "xunit-package",
    "nunit": "nunit-package",
    "mstest.testframework": "mstest-package",
    "benchmarkdotnet": "benchmarkdotnet-package",
}
TEST_PACKAGE_REASONS = ["test-sdk-package", "xunit-package", "nunit-package", "mstest-package"]
TEST_NAME_REASONS = ["project-name-test", "project-path-test", "assembly-name-test"]


def classify_projects(projects: DataFrame, package_refs: DataFrame) -> DataFrame:
    """Reason codes of each project of a repository, then its kind by the strongest reason, with confidence."""
    package = F.lower("name")
    mapped = F.create_map(*[F.lit(x) for pair in PACKAGE_REASONS.items() for x in pair])
    signals = (
        package_refs.filter(package.isin(list(PACKAGE_REASONS)))
        .select("repo", "project_id", F.try_element_at(mapped, package).alias("r"))
        .groupBy("repo", "project_id")
        .agg(F.collect_set("r").alias("package_reasons"))
    )

    def mentions(c: str) -> Column:
        return F.coalesce(F.lower(c).contains("test"), F.lit(False))

    output = F.lower(F.coalesce(F.trim("output_type"), F.lit("")))
    own = reasons(
        (F.coalesce(F.col("pack_as_tool"), F.lit(False)), "pack-as-tool"),
        (output == "exe", "output-type-exe"),
        (output.isin("library", ""), "output-type-library"),
        (mentions("name"), "project-name-test"),
        (mentions("path"), "project-path-test"),
        (mentions("assembly_name"), "assembly-name-test"),
        (F.lower("sdk") == "microsoft.net.sdk.web", "sdk-web"),
    )
    none = F.array().cast("array<string>")
    codes = ordered_reasons(F.concat(F.coalesce("package_reasons", none), own), PROJECT_REASONS)

    def has(*wanted: str) -> Column:
        return F.arrays_overlap("codes", F.array(*[F.lit(w) for w in wanted]))

    kind = (
        F.when(has(*TEST_PACKAGE_REASONS, *TEST_NAME_REASONS), "test")
        .when(has("benchmarkdotnet-package"), "benchmark")
        .when(has("pack-as-tool"), "tooling")
        .when(has("output-type-exe"), "executable")
        .when(has("output-type-library"), "library")
        .otherwise("unknown")
    )
    confidence = (
        F.when(F.col("kind") == "test", F.when(has(*TEST_PACKAGE_REASONS), "high").otherwise("medium"))
        .when(F.col("kind").isin("benchmark", "tooling", "executable"), "high")
        .when(F.col("kind") == "library", "medium")
        .otherwise("low")
    )
    empty = F.size("codes") == 0
    return (
        projects.join(signals, ["repo", "project_id"], "left")
        .withColumn("codes", codes)
        .withColumn("kind", kind)
        .withColumn("confidence", confidence)
        .withColumn("reason_codes", F.when(empty, F.array(F.lit("no-classification-signals"))).otherwise(F.col("codes")))
        .drop("codes", "package_reasons")
    )


# Attribute short names and the test framework they belong to.
TEST_ATTRIBUTES = {
    "Fact": "xunit",
    "Theory": "xunit",
    "Test": "nunit",
    "TestCase": "nunit",
    "TestMethod": "mstest",
    "DataTestMethod": "mstest",
}
TEST_BASE_SCORE = 10


def discover_tests(methods: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Methods whose attributes name a test framework: framework of the first such attribute, base score, reason."""
    table = F.create_map(*[F.lit(x) for pair in TEST_ATTRIBUTES.items() for x in pair])
    frameworks = F.array_compact(F.transform("attributes", lambda a: F.try_element_at(table, short_attribute(a))))
    found = methods.withColumn("framework", F.get(frameworks, 0)).filter(F.col("framework").isNotNull())
    if projects is not None:
        tests = projects.filter(F.col("kind") == "test").select(F.col("name").alias("project")).distinct()
        found = found.join(tests, "project", "left_semi")
    return found.withColumn("score", F.lit(TEST_BASE_SCORE)).withColumn("reason_codes", F.array(F.lit("test-method-attribute")))


def filter_diagnostics(diags: DataFrame, severities=(), ids=(), exclude_generated: bool = True) -> DataFrame:
    if severities:
        diags = diags.filter(F.col("severity").isin(list(severities)))
    if ids:
        diags = diags.filter(F.col("id").isin(list(ids)))
    return diags.filter(~is_generated_path("path")) if exclude_generated else diags


def scope_to_projects(files: DataFrame, projects: DataFrame | None) -> DataFrame:
    """Files below the directory of any project; without projects all files."""
    if projects is None:
        return files
    dirs = projects.select("repo", directory("path").alias("__dir")).distinct()
    above = files.select("repo", "path").distinct().withColumn("__dir", F.explode(ancestor_dirs("path")))
    inside = above.join(dirs, ["repo", "__dir"], "left_semi").select("repo", "path").distinct()
    return files.join(inside, ["repo", "path"], "left_semi")


def filter_routes(routes: DataFrame, fragments=(), kinds=(), auth: str | None = None) -> DataFrame:
    """Route fragment in any case, endpoint kind ('any' passes all), authorisation state."""
    if fragments:
        text = F.lower(F.coalesce("normalized_pattern", "pattern", F.lit("")))
        routes = routes.filter(any_of(text.contains(f.lower()) for f in fragments))
    if kinds and "any" not in kinds:
        routes = routes.filter(F.col("endpoint_kind").isin(list(kinds)))
    return routes.filter(F.col("auth_kind") == auth) if auth in ("required", "anonymous", "unknown") else routes


def symbol_text_matches(query: str, cols=("name", "container", "fqn", "display")) -> Column:
    text = query.strip().lower()
    return any_of(F.coalesce(F.lower(F.col(c)).contains(text), F.lit(False)) for c in cols)


def filter_symbol_text(df: DataFrame, query: str | None, cols=("name", "container", "fqn", "display")) -> DataFrame:
    """Rows where any text column contains the query in any case; a blank query passes all."""
    return df.filter(symbol_text_matches(query, cols)) if query and query.strip() else df


API_ACCESS = ["Public", "Protected", "ProtectedOrInternal"]


def api_visible(symbols: DataFrame, containment: DataFrame) -> DataFrame:
    """Public or protected symbols all of whose containing types are visible too.

    ``containment(child_id, parent_id)``.
    """
    visible = symbols.filter(F.col("accessibility").isin(API_ACCESS))
    hidden = symbols.filter(~F.coalesce(F.col("accessibility").isin(API_ACCESS), F.lit(False)))
    seeds = hidden.select(F.col("symbol_id").alias("target_id"), F.col("symbol_id").alias("node"))
    below = closure(containment, seeds, "parent_id", "child_id").select(F.col("node").alias("symbol_id")).distinct()
    return visible.join(below, "symbol_id", "left_anti")


def public_contract_changes(changed: DataFrame) -> DataFrame:
    """Changed symbols that are part of a public contract, with code and reasons."""
    codes = F.array(F.lit("current-public-symbol-changed"), F.lit("public-accessibility"))
    return (
        changed.filter(F.col("accessibility").isin(API_ACCESS))
        .withColumn("code", F.lit("changed-public-symbol"))
        .withColumn("confidence", F.lit("medium"))
        .withColumn("reason_codes", codes)
    )


def looks_like_path(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(r"[/\\]|(?i)\.(cs|vb)proj$")


def resolve_project_filters(filters: DataFrame, projects: DataFrame) -> DataFrame:
    """Each filter by path, else by exact name unless it looks like a path: resolved, ambiguous or unknown."""
    asked = filters.select(F.trim("filter").alias("filter")).distinct().withColumn("__path", forward_slashes("filter"))
    by_path = asked.join(projects.select(F.col("path").alias("__path"), "project_id"), "__path").select("filter", "project_id")
    rest = asked.filter(~looks_like_path("filter")).join(by_path.select("filter").distinct(), "filter", "left_anti")
    by_name = rest.join(projects.select(F.col("name").alias("filter"), "project_id"), "filter").select("filter", "project_id")
    hits = by_path.unionByName(by_name)
    counts = hits.groupBy("filter").agg(F.count("*").alias("match_count"), F.min("project_id").alias("first_id"))
    joined = asked.select("filter").join(counts, "filter", "left")
    status = (
        F.when(F.col("match_count").isNull(), "unknown").when(F.col("match_count") > 1, "ambiguous").otherwise("resolved")
    )
    return joined.select(
        "filter", status.alias("status"), F.coalesce("match_count", F.lit(0)).alias("match_count"),
        F.when(F.col("match_count") == 1, F.col("first_id")).alias("project_id"),
    )
