from pyspark.sql import functions as F

from factspan.functions import names, paths
from factspan.operators import budget, chains, evals, filters, graph, impact, injection

ITEMS = (
    "pack_id string, item_id string, kind string, reason_codes array<string>, lines array<string>, path string, line int, column int, end_line int, end_column int"
)


def _items(spark, *rows):
    data = [("p", i, kind, ["test"], [text], "file.cs", 1, 1, 1, 1) for i, kind, text in rows]
    return budget.rank_context(budget.with_chars(spark.createDataFrame(data, ITEMS)), "understand")


def test_item_limit(spark):
    items = _items(spark, ("a", "definition", "alpha"), ("b", "reference", "beta"), ("c", "diagnostic", "gamma"))
    kept = [r.item_id for r in budget.apply_budget(items, 100, 2).orderBy("position").collect()]
    row = budget.budget_summary(items, 100, 2).collect()[0]
    assert kept == ["a", "b"] and not row.budget_truncated
    assert (row.omitted_reason, row.first_omitted_id, row.omitted_items) == ("item-limit", "c", 1)


def test_budget_stops_at_first_overflow(spark):
    items = _items(spark, ("a", "definition", "ok"), ("b", "reference", "x" * 52), ("c", "diagnostic", "z"))
    kept = [(r.item_id, r.has_content) for r in budget.apply_budget(items, 10, 10).orderBy("position").collect()]
    row = budget.budget_summary(items, 10, 10).collect()[0]
    assert kept == [("a", True), ("b", False)] and row.budget_truncated
    assert (row.first_omitted_id, row.chars_used, row.omitted_items) == ("b", 23, 2)


def test_project_classes(spark):
    projects = spark.createDataFrame(
        [("r", "1", "App", "a.csproj", None, None, None, False), ("r", "2", "Cli", "c.csproj", None, None, "Exe", True)],
        "repo string, project_id string, name string, path string, assembly_name string, sdk string, output_type string, pack_as_tool boolean",
    )
    packages = spark.createDataFrame([("r", "1", "Microsoft.NET.Test.Sdk"), ("r", "1", "xunit")], "repo string, project_id string, name string")
    got = {r.project_id: (r.kind, r.confidence, r.reason_codes) for r in filters.classify_projects(projects, packages).collect()}
    assert got["1"] == ("test", "high", ["test-sdk-package", "xunit-package", "output-type-library"])
    assert got["2"][:2] == ("tooling", "high") and "pack-as-tool" in got["2"][2]


def test_generated_paths(spark):
    cases = {"a/X.g.cs": True, "obj/x.cs": True, "a\\BIN\\x.cs": True, "a/TemporaryGeneratedFile_1.cs": True, "a/x.Designer.vb": True, "a/objx/x.cs": False, " ": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.g for r in df.select("path", paths.is_generated_path("path").alias("g")).collect()} == cases


def test_lines_of_text(spark):
    df = spark.createDataFrame([("a\r\nb\n",), ("a\n\n",), ("",), ("x",)], "t string")
    assert [r.l for r in df.select(paths.lines_of("t").alias("l")).collect()] == [["a", "b"], ["a", ""], [], ["x"]]


def test_target_framework(spark):
    df = spark.createDataFrame(
        [("App (net8.0)", []), ("App", ["DEBUG", "NET6_0", "NETSTANDARD2_0"]), ("App", ["NET472"]), ("App", [])], "n string, s array<string>"
    )
    assert [r.f for r in df.select(names.target_framework("n", "s").alias("f")).collect()] == ["net8.0", "net6.0", "net4.7.2", None]


def _di(spark):
    rows = [
        ("AddScoped", ["IWidgetStore", "SqlWidgetStore"], 90), ("AddTransient", ["WidgetService"], 91), ("AddSingleton", ["RootSingleton"], 92),
        ("AddScoped", ["ScopedThing"], 93), ("AddHostedService", ["Worker"], 94), ("Configure", ["WidgetOptions"], 95), ("Other", ["X"], 96),
    ]
    data = [(m, a, [], None, False, None, "App", "f.cs", n, 1, n, 9) for m, a, n in rows]
    calls = spark.createDataFrame(
        data, "method_name string, type_args array<string>, typeof_args array<string>, descriptor_name string, has_factory boolean, instance_type string, project string, path string, line int, column int, end_line int, end_column int"
    )
    params = spark.createDataFrame(
        [("SqlWidgetStore", "Microsoft.Extensions.Logging.ILogger<SqlWidgetStore>"), ("WidgetService", "IWidgetStore"), ("RootSingleton", "ScopedThing")], "type_id string, type_fqn string"
    )
    params = params.selectExpr("*", "1 AS ctor_ordinal", "'Public' AS ctor_access", "1 AS ctor_line", "false AS is_marked", "'p' AS name", "0 AS ordinal", "false AS optional")
    return injection.di_registrations(calls), params


def test_registrations_and_risks(spark):
    regs, params = _di(spark)
    kinds = {(r.registration_kind, r.lifetime) for r in regs.collect()}
    assert ("hostedService", "singleton") in kinds and ("options", "unknown") in kinds and regs.count() == 6
    deps = injection.di_dependencies(regs, params)
    assert ("WidgetService", "IWidgetStore") in {(r.implementation_type, r.dependency_type) for r in deps.collect()}
    risks = [(r.risk_kind, r.implementation_type, r.dependency_type) for r in injection.di_risks(regs, deps).collect()]
    assert risks == [("captive-dependency", "RootSingleton", "ScopedThing")]


def test_closure_survives_cycles_and_hot_nodes(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a")] + [("c", f"x{i}") for i in range(500)]
    df = spark.createDataFrame(edges, "s string, d string")
    seeds = spark.createDataFrame([("t", "a")], "target_id string, node string")
    got = {r.node: r.depth for r in graph.closure(df, seeds, "s", "d").collect()}
    assert got == {"b": 1, "c": 2, **{f"x{i}": 3 for i in range(500)}}


def test_chains(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("e", "a")], "caller_id string, callee_id string")
    places = spark.createDataFrame([(s, f"{s}.cs", 1, 1) for s in "abce"], "symbol_id string, path string, line int, column int")
    asked = spark.createDataFrame([("t", "a")], "target_id string, symbol_id string")
    got = {("".join(r.chain), r.end_reason) for r in chains.upstream_chains(asked, edges, places).collect()}
    assert got == {("ae", "no-upstream-callers"), ("abca", "cycle-detected")}
    short = {("".join(r.chain), r.end_reason) for r in chains.upstream_chains(asked, edges, places, depth=1).collect()}
    assert short == {("ae", "depth-limit"), ("ab", "depth-limit")}


def test_guard_without_changes_is_high_risk(spark):
    cols = "anchor_id string, change_id string, candidate_id string, name string, kind string, container string, path string, project string"
    anchors = spark.createDataFrame([("1", "c", None, "N", "Method", "C", "a/b.cs", "P"), ("2", "d", "sym", "N", "Method", "C", "a.cs", "P")], cols)
    changed = spark.createDataFrame([("c", "s", "N", "Method", "C", "a\\b.cs", None, 4)], "change_id string, symbol_id string, name string, kind string, container string, path string, project string, line int")
    got = {r.anchor_id: r for r in impact.edit_guard(anchors, changed).collect()}
    assert (got["1"].risk, got["1"].best_score, got["1"].passed) == ("low", 0.9, True)
    assert (got["2"].risk, got["2"].passed) == ("high", False)
    assert got["2"].reason_codes == ["anchor-risk-requires-review", "no-anchor-match", "no-changed-symbols-found"]


def test_trace_gates_pass_on_clean_traces(spark):
    rows = [("all", "text-only", "canonical", False, False, True, "done", 0)] + [("all", "edit", "canonical", True, False, True, "done", c) for c in (100, 19600)]
    df = spark.createDataFrame(rows, "run string, kind string, surface string, used_tool boolean, broad_checklist boolean, anchor_before_edit boolean, stop_condition string, stdout_chars int")
    bounds = {"text_only": 0, "broad": 0, "unanchored": 0, "stop": 1, "p95_chars": 20000, "max_chars": 20000}
    row = evals.trace_gates(df, bounds, keys=["run"]).collect()[0]
    assert (row.canonical_p95, row.canonical_max, row.score, row.passed) == (19600, 19600, 1.0, True)


def test_test_frameworks(spark):
    df = spark.createDataFrame([("a", ["Xunit.FactAttribute"]), ("b", ["Obsolete", "TestCase"]), ("c", ["DataTestMethod"]), ("d", ["Contest"])], "name string, attributes array<string>")
    assert {r.name: r.framework for r in filters.discover_tests(df).collect()} == {"a": "xunit", "b": "nunit", "c": "mstest"}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], ITEMS + ", chars long, priority int")
    assert budget.apply_budget(none, 10, 10).count() == 0 and budget.budget_summary(none, 10, 10).count() == 0
    seeds = spark.createDataFrame([], "target_id string, node string")
    assert graph.closure(spark.createDataFrame([], "s string, d string"), seeds, "s", "d").count() == 0


def test_functions_do_not_depend_on_input_partitioning(spark):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("pack_id"), F.col("id").cast("string").alias("item_id"), F.lit(1).alias("priority"), F.lit("k").alias("kind"),
                                 F.lit("p").alias("path"), *[F.lit(1).alias(c) for c in ("line", "column", "end_line", "end_column")], F.lit(9).alias("chars"))
    rows = lambda d: sorted((r.pack_id, r.item_id, r.position) for r in budget.apply_budget(d, 20, 5).collect())
    assert rows(df) == rows(df.repartition(7))
