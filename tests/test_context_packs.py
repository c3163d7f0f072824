"""Diagnostics of crowded files in context packs: totals and first items as if every diagnostic met every target."""

from pyspark.sql import functions as F

from factspan.plans import context

DIAG = "project string, severity string, id string, message string, path string, line int, `column` int, end_line int, end_column int"
PLACE = "path string, line int, `column` int, end_line int, end_column int"


def _facts(spark, diags):
    decls = spark.createDataFrame(
        [("S1", "A", "Method", "C", "A.x", "a.cs", 1, 1, 9, 1), ("S2", "B", "Method", "C", "B.x", "b.cs", 2, 1, 9, 1)],
        f"symbol_id string, name string, kind string, container string, fqn string, {PLACE}",
    )
    chosen = decls.select(F.col("symbol_id").alias("target_id"), "symbol_id")
    refs = spark.createDataFrame(
        [("S1", "read", "P", "r.cs", 4, 1, 4, 5), ("S2", "read", "P", "r.cs", 5, 1, 5, 5)], f"target_symbol_id string, usage_kind string, project string, {PLACE}"
    )
    calls = spark.createDataFrame([], f"caller_id string, callee_id string, {PLACE}")
    types = spark.createDataFrame([], "child_id string, parent_id string, edge_kind string")
    return chosen, decls, refs, calls, types, spark.createDataFrame(diags, DIAG)


def _diags(n):
    """``n`` places in one file, each with copies that differ by message, an id that is missing, and a diagnostic without a file."""
    rows = [("P", "Error", f"CS{i % 3}", f"m{j}", "r.cs", i, 1, None, 2) for i in range(n) for j in range(4)]
    rows += [("P", "Error", None, "m1", "r.cs", 0, 1, None, 2), ("P", "Error", "", "m0", "r.cs", 0, 1, None, 2)]
    return rows + [("P", "Error", "CS9", "m", None, None, 1, None, 2), ("P", "Error", "CS9", "m", "a.cs", 3, 1, 3, 2)]


def test_a_file_gives_a_pack_its_first_diagnostics_and_true_totals(spark):
    facts = _facts(spark, _diags(40))
    docs = spark.createDataFrame([("a.cs", "x\ny\nz")], "path string, text string")
    cut = context.query_items(*facts, 6)
    assert cut.filter("kind = 'diagnostic' AND path = 'r.cs'").groupBy("pack_id").count().agg(F.max("count")).first()[0] == 7
    assert {r["left_out"] for r in cut.filter("kind = 'diagnostic' AND left_out > 0").collect()} == {41 - 7}
    packs = [context.context_pack(items, docs, "modify", budget_tokens=900, item_limit=6) for items in (cut, context.query_items(*facts))]
    for part in ("items", "sections", "summary"):
        few, all_ = ([r.asDict(True) for r in p[part].orderBy(*[c for c in ("pack_id", "kind", "position") if c in p[part].columns]).collect()] for p in packs)
        assert few == all_ and few
    totals = {r["pack_id"]: r["total"] for r in packs[0]["sections"].filter("kind = 'diagnostic'").collect()}
    assert totals == {"S1": 42, "S2": 41}


def test_copies_of_a_diagnostic_are_merged_before_they_meet_the_targets(spark):
    items = context.query_items(*_facts(spark, _diags(5))).filter("kind = 'diagnostic'")
    rows = {(r["path"], r["line"], r["item_id"].rsplit(":", 1)[1]): r["message"] for r in items.filter("pack_id = 'S2'").collect()}
    assert rows == {("r.cs", i, f"CS{i % 3}"): "m0" for i in range(5)} | {("r.cs", 0, ""): "m0"}
    assert items.groupBy("pack_id", "item_id").count().agg(F.max("count")).first()[0] == 1
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [path" in plan[plan.index("Join Inner, (path"):]


def _several_files(spark):
    """The facts with two files for each target, both crowded, one of them also the file of a declaration."""
    diags = _diags(9) + [("P", "Error", "CS1", f"m{i % 2}", "b.cs", i, 2, i, 3) for i in range(20)]
    chosen, decls, refs, calls, types, diags = _facts(spark, diags)
    more = spark.createDataFrame([("S1", "read", "P", "b.cs", 40, 1, 40, 5), ("S1", "read", "P", "none.cs", 1, 1, 1, 5)], refs.schema)
    return chosen, decls, refs.unionByName(more), calls, types, diags


def _pack_rows(pack):
    return {part: sorted((str(r.asDict(True)) for r in pack[part].collect())) for part in ("items", "sections", "summary")}


def test_only_the_first_files_of_a_target_give_a_pack_diagnostics(spark):
    """Every file in scope gave its first diagnostics to every target."""
    facts = _several_files(spark)
    docs = spark.createDataFrame([("a.cs", "x\ny\nz"), ("b.cs", "u\nv")], "path string, text string")
    cut = context.query_items(*facts, 6)
    rows = cut.filter("kind = 'diagnostic'").groupBy("pack_id", "path").agg(F.count("*").alias("n"), F.sum("left_out").alias("left_out")).collect()
    assert {(r["pack_id"], r["path"]): (r["n"], r["left_out"]) for r in rows} == {
        ("S1", "a.cs"): (1, 0), ("S1", "b.cs"): (7, 13 + 10), ("S2", "b.cs"): (7, 13 + 10)
    }
    whole = _pack_rows(context.context_pack(context.query_items(*facts), docs, "modify", budget_tokens=900, item_limit=6))
    assert _pack_rows(context.context_pack(cut, docs, "modify", budget_tokens=900, item_limit=6)) == whole
    # Large packs are dealt over several tasks.
    assert _pack_rows(context.context_pack(cut, docs, "modify", budget_tokens=900, item_limit=6, hot=2)) == whole
