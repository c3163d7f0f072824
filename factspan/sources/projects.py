"""Project files: properties, package and project references, central versions, build-file coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import project_id
from ..functions.paths import ancestor_dirs, directory, file_name, in_build_output
from ..operators.core import dedupe_first

_ITEM = "_Include string, _Update string, _Version string, Version string, _PrivateAssets string, PrivateAssets string"
_ROOT = "_Sdk string, _corrupt string"
_ATTRIBUTES = """(?:[^>"']|"[^"]*"|'[^']*')*?"""
COVERAGE_NAMES = ["Directory.Build.props", "Directory.Build.targets", "Directory.Packages.props"]
CENTRAL_NAME = "Directory.Packages.props"


def _blank_to_null(c: Column) -> Column:
    c = F.trim(c)
    return F.when(c != "", c)


def _plain_xml(xml) -> Column:
    """XML text without comments, instructions and prefixes of names, and with CDATA sections as escaped text, so that tags can be found by patterns."""
    parts = F.split(F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>", ""), r"<!\[CDATA\[", -1)
    escaped = lambda t: F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    ends = lambda p: F.instr(p, "]]>")
    section = lambda p: F.when(ends(p) > 0, F.concat(escaped(F.substring(p, F.lit(1), ends(p) - 1)), F.substring(p, ends(p) + 3, F.length(p)))).otherwise(p)
    text = F.array_join(F.transform(parts, lambda p, n: F.when(n == 0, p).otherwise(section(p))), "")
    return F.regexp_replace(text, r"<(/?)[\w.-]+:", "<$1")


def _elements(xml: Column, name: str) -> Column:
    """The elements of a name at any depth, as XML texts in the order of the file."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}(?=[\s/>]){_ATTRIBUTES}(?:/>|>.*?</{name}\s*>)"), F.lit(0))


def _property(name: str) -> Column:
    """First non-blank text of the elements of a name, wherever they stand."""
    inner = F.regexp_extract_all(F.col("plain"), F.lit(rf"(?s)<{name}(?=[\s>]){_ATTRIBUTES}>(.*?)</{name}\s*>"), F.lit(1))

    def text(value: Column) -> Column:
        value = F.regexp_replace(value, "<[^>]*>", "")
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            value = F.replace(value, F.lit(entity), F.lit(sign))
        return _blank_to_null(value)

    return F.get(F.array_compact(F.transform(inner, text)), 0)


def _parsed(project_files: DataFrame) -> DataFrame:
    """Files with their root (x), whether they are broken, and their text made plain (null where broken)."""
    options = {"rowTag": "Project", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = project_files.withColumn("x", F.from_xml("xml", _ROOT, options))
    broken = F.col("x._corrupt").isNotNull() | (F.trim(F.coalesce("xml", F.lit(""))) == "")
    return parsed.withColumn("broken", broken).withColumn("plain", F.when(~F.col("broken"), _plain_xml("xml")))


def _is_true(c: Column) -> Column:
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def read_projects(project_files: DataFrame) -> DataFrame:
    """One row per project file: sdk, output type, frameworks, tool flag and parse warning."""
    parsed = _parsed(project_files)
    frameworks = F.coalesce(_property("TargetFrameworks"), _property("TargetFramework"), F.lit(""))
    parts = F.filter(F.transform(F.split(frameworks, ";"), lambda s: F.trim(s)), lambda s: s != "")
    name = F.regexp_replace(file_name("path"), r"\.[^.]*$", "")
    return parsed.select(
        "repo", "path", name.alias("name"),
        project_id("path", name, F.lit(None)).alias("project_id"),
        F.col("x._Sdk").alias("sdk"),
        _property("OutputType").alias("output_type"),
        _property("Nullable").alias("nullable"),
        _property("AssemblyName").alias("assembly_name"),
        F.coalesce(F.array_sort(F.array_distinct(parts)), F.array().cast("array<string>")).alias("target_frameworks"),
        _is_true(_property("PackAsTool")).alias("pack_as_tool"),
        F.when(F.col("broken"), F.lit("project-file-parse-failed")).alias("warning"),
        F.coalesce(F.col("xml").rlike(r"<(Choose|When|Otherwise)[\s>]"), F.lit(False)).alias("has_conditional_items"),
    )


def _items(parsed: DataFrame, element: str) -> DataFrame:
    """Items of a name at any depth: below groups, choices and targets alike."""
    name = project_id("path", F.col("path"), F.lit(None))
    found = parsed.select("repo", "path", name.alias("project_id"), F.explode(_elements(F.col("plain"), element)).alias("element"))
    return found.select("repo", "path", "project_id", F.from_xml("element", _ITEM, {"rowTag": element}).alias("i"))


def read_package_refs(project_files: DataFrame) -> DataFrame:
    """Package references with their own version, null where they state none."""
    rows = _items(_parsed(project_files), "PackageReference")
    return rows.select(
        "repo", "path", "project_id",
        F.coalesce(F.trim("i._Include"), F.trim("i._Update")).alias("name"),
        F.coalesce(_blank_to_null(F.col("i._Version")), _blank_to_null(F.col("i.Version"))).alias("version"),
        F.coalesce(_blank_to_null(F.col("i._PrivateAssets")), _blank_to_null(F.col("i.PrivateAssets"))).alias("private_assets"),
    ).filter(F.trim("name") != "")


def resolve_relative(base_dir: Column, include: Column) -> Column:
    """Path of an include below a directory with '.' and '..' parts resolved; '..' above the root stay in front."""
    joined = F.concat_ws("/", F.when(base_dir != "", base_dir), F.translate(include, "\\", "/"))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def read_project_refs(project_files: DataFrame) -> DataFrame:
    rows = _items(_parsed(project_files), "ProjectReference").filter(F.trim("i._Include") != "")
    include = F.trim("i._Include")
    return rows.select(
        "repo", "project_id", include.alias("include"), resolve_relative(directory("path"), include).alias("path")
    )


def read_central_versions(central_files: DataFrame) -> DataFrame:
    """(repo, dir, name, version) stated by central package files."""
    rows = _items(_parsed(central_files), "PackageVersion")
    named = rows.select(
        "repo", directory("path").alias("dir"),
        F.coalesce(F.trim("i._Include"), F.trim("i._Update")).alias("name"),
        F.coalesce(_blank_to_null(F.col("i._Version")), _blank_to_null(F.col("i.Version"))).alias("version"),
    )
    return named.filter((F.trim("name") != "") & F.col("version").isNotNull())


def inherit_central_versions(package_refs: DataFrame, central_versions: DataFrame) -> DataFrame:
    """A package without a version takes it from the nearest directory above that states one.

    Directories above a project are exploded once per distinct (path, name), so the join is an equi-join and a
    popular package is spread over the directories.
    """
    missing = package_refs.filter(F.col("version").isNull()).select("repo", "path", "name").distinct()
    above = missing.withColumn("dir", F.explode(ancestor_dirs("path")))
    stated = dedupe_first(central_versions, ["repo", "dir", "name"], ["version"])
    found = (
        above.join(stated, ["repo", "dir", "name"])
        .groupBy("repo", "path", "name")
        .agg(F.max_by("version", F.length("dir")).alias("central_version"))
    )
    joined = package_refs.join(found, ["repo", "path", "name"], "left")
    central = F.col("version").isNull() & F.col("central_version").isNotNull()
    return (
        joined.withColumn("is_central", central)
        .withColumn("version", F.coalesce("version", "central_version"))
        .drop("central_version")
    )


def config_file_coverage(config_files: DataFrame, projects: DataFrame) -> DataFrame:
    """(config path, project) rows for the projects below each shared build file's directory; build outputs ignored.

    A root file covers every project of a repository, so the list stays rows.
    """
    files = config_files.filter(file_name("path").isin(COVERAGE_NAMES) & ~in_build_output("path")).select(
        "repo", F.col("path").alias("config_path"), file_name("path").alias("kind"), directory("path").alias("dir")
    )
    below = projects.select("repo", "project_id", F.explode(ancestor_dirs("path")).alias("dir"))
    return files.join(below, ["repo", "dir"], "left").select("repo", "config_path", "kind", "project_id")


def config_file_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("repo", "config_path", "kind").agg(F.count("project_id").alias("project_count"))


def central_management(config_files: DataFrame) -> DataFrame:
    """Per repository: central versions enabled, number of central files, first of them."""
    central = config_files.filter((file_name("path") == CENTRAL_NAME) & ~in_build_output("path"))
    parsed = _parsed(central)
    lists = F.size(_elements(F.col("plain"), "PackageVersion")) > 0
    on = _is_true(_property("ManagePackageVersionsCentrally")) | F.coalesce(lists, F.lit(False))
    return parsed.groupBy("repo").agg(
        F.bool_or(on).alias("enabled"), F.count("*").alias("file_count"), F.min("path").alias("first_file")
    )


def project_edges(projects: DataFrame, project_refs: DataFrame, extra_refs: DataFrame | None = None) -> DataFrame:
    """Declared references with the referenced project's id, null when unknown; one row per edge.

    ``extra_refs(repo, project_id, include, path)`` is a second source of references.
    """
    refs = project_refs.select("repo", "project_id", "include", "path").withColumn("__source", F.lit(1))
    if extra_refs is not None:
        refs = extra_refs.select("repo", "project_id", "include", "path").withColumn("__source", F.lit(0)).unionByName(refs)
    ids = dedupe_first(projects.select("repo", "path", F.col("project_id").alias("to_project_id")), ["repo", "path"], ["to_project_id"])
    joined = refs.withColumnRenamed("project_id", "from_project_id").join(ids, ["repo", "path"], "left")
    unique = dedupe_first(joined, ["repo", "from_project_id", "to_project_id", "path"], ["__source", "include"])
    return unique.drop("__source")


def test_relationships(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges from a test project to a production project of the same repository, with reasons."""
    tests = classes.filter(F.col("kind") == "test").select("repo", F.col("project_id").alias("from_project_id"), "reason_codes")
    production = classes.filter(~F.col("kind").isin("test", "benchmark", "unknown")).select(
        "repo", F.col("project_id").alias("to_project_id")
    )
    packages = F.filter("reason_codes", lambda r: r.endswith("-package"))
    own = F.array(F.lit("test-project-classification"), F.lit("project-reference-to-production"))
    return (
        edges.select("repo", "from_project_id", "to_project_id")
        .distinct()
        .join(tests, ["repo", "from_project_id"])
        .join(production, ["repo", "to_project_id"])
        .select(
            "repo", F.lit("tests").alias("kind"), "from_project_id", "to_project_id", F.lit("high").alias("confidence"),
            F.array_sort(F.array_union(own, packages)).alias("reason_codes"),
        )
    )
