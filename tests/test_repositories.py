"""Equal names in two repositories, and the faulty inputs of project files, diffs and patterns."""

from pyspark.sql import functions as F

from factspan.functions import paths
from factspan.operators import ranking
from factspan.plans import lookup, repositories
from factspan.sources import projects

APP = '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><OutputType>Exe</OutputType></PropertyGroup></Project>'
TESTS = '<Project><ItemGroup><PackageReference Include="xunit" Version="2"/><ProjectReference Include="../B/B.csproj"/></ItemGroup></Project>'
LIBRARY = "<Project><PropertyGroup><OutputType>Library</OutputType></PropertyGroup></Project>"


def test_equal_project_paths_in_two_repositories(spark):
    rows = [("r1", "A/A.csproj", TESTS), ("r1", "B/B.csproj", LIBRARY), ("r2", "A/A.csproj", APP), ("r2", "B/B.csproj", LIBRARY)]
    files = spark.createDataFrame(rows, "repo string, path string, xml string")
    found = repositories.repo_graph(files, files.limit(0))
    kinds = {(r.repo, r.path): r.kind for r in found["projects"].collect()}
    assert kinds == {("r1", "A/A.csproj"): "test", ("r1", "B/B.csproj"): "library", ("r2", "A/A.csproj"): "executable", ("r2", "B/B.csproj"): "library"}
    assert [r.repo for r in found["test_relationships"].collect()] == ["r1"]


def test_only_unreadable_project_files_are_reported(spark):
    fine = ["<Project><Import Project='x'/></Project>", "<Project><Sdk Name='x'/><Target Name='t'/></Project>", APP]
    rows = [("r", f"{i}.csproj", xml) for i, xml in enumerate([*fine, "<Project><Open></Project>", "", None])]
    files = spark.createDataFrame(rows, "repo string, path string, xml string")
    assert {r.path for r in projects.read_projects(files).collect() if r.warning} == {"3.csproj", "4.csproj", "5.csproj"}


def test_parent_folders_above_the_root_stay(spark):
    df = spark.range(1).select(projects.resolve_relative(F.lit("src"), F.lit("..\\..\\..\\x")).alias("up"), projects.resolve_relative(F.lit("a/b"), F.lit("../c")).alias("side"))
    assert tuple(df.first()) == ("../../x", "a/c")


def test_quoted_paths(spark):
    cases = {'"b/caf\\303\\251.cs"': "café.cs", '"b/a\\tb.cs"': "a\tb.cs", '"b/a\\"q\\".cs"': 'a"q".cs', "b/plain é.cs": "plain é.cs"}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.p for r in df.select("path", paths.normalize_path("path").alias("p")).collect()} == cases


def test_patterns(spark):
    columns = "symbol_id string, name string, kind string, container string, fqn string, namespace string, accessibility string, project string, path string, line int, column int, end_line int, end_column int, is_generated boolean"
    decls = spark.createDataFrame([("s1", "alpha", "Method", None, "alpha", None, "Public", "p", "a.cs", 1, 1, 1, 2, False)], columns)
    rows = [("t1", "^al.*", "regex", False, None), ("t2", "(", "regex", True, None)]
    targets = spark.createDataFrame(rows, "target_id string, query string, match string, case_sensitive boolean, assume_kinds array<string>")
    found = lookup.find(targets, decls)
    assert {r.target_id: r.confidence for r in found["choice"].collect()}["t1"] != "none"
    assert [tuple(r) for r in found["invalid"].collect()] == [("t2", "invalid-pattern")]
    assert {r.target_id for r in ranking.match_names(targets, decls, with_regex=True).collect()} == {"t1"}


def test_items_and_properties_at_any_depth(spark):
    xml = """<?xml version="1.0"?><Project xmlns="http://x" xmlns:m="http://y" Sdk="S"><!-- <PackageReference Include="Comment"/> -->
    <Choose><When Condition="'$(A)' > '1'"><PropertyGroup><OutputType Condition="a">  </OutputType><OutputType>Exe</OutputType></PropertyGroup>
      <ItemGroup><PackageReference Include="A &amp; B" Version='1>0' /></ItemGroup></When>
      <Otherwise><ItemGroup><PackageReference
          Include="C"><Version>2</Version><PrivateAssets>all</PrivateAssets></PackageReference></ItemGroup></Otherwise></Choose>
    <Target Name="t"><ItemGroup><m:PackageReference Update="D" Version="4"></m:PackageReference><PackageReferences Include="No"/><ProjectReference Include="..\\L\\L.csproj"/></ItemGroup>
      <PropertyGroup><AssemblyName><![CDATA[A<B>]]></AssemblyName><Nullable>en&lt;able</Nullable></PropertyGroup></Target>
    <Note><![CDATA[<PackageReference Include="Text"/>]]></Note></Project>"""
    files = spark.createDataFrame([("r", "P/P.csproj", xml), ("r", "Q/Q.csproj", xml[:-3])], "repo string, path string, xml string")
    packages = projects.read_package_refs(files).select("path", "name", "version", "private_assets").collect()
    assert [tuple(p) for p in packages] == [("P/P.csproj", "A & B", "1>0", None), ("P/P.csproj", "C", "2", "all"), ("P/P.csproj", "D", "4", None)]
    assert [(r.include, r.path) for r in projects.read_project_refs(files).collect()] == [("..\\L\\L.csproj", "L/L.csproj")]
    read = {r.path: r for r in projects.read_projects(files).collect()}
    good, bad = read["P/P.csproj"], read["Q/Q.csproj"]
    assert (good.sdk, good.output_type, good.assembly_name, good.nullable, good.warning) == ("S", "Exe", "A<B>", "en<able", None)
    assert (bad.output_type, bad.target_frameworks, bad.warning) == (None, [], "project-file-parse-failed")
