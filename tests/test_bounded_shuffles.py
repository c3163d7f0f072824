"""What goes through the shuffles of span, usage, slice and numbering operators."""

from pyspark.sql import functions as F

from factspan.operators import budget, graph, spans, usage


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_points_look_only_into_the_widths_that_spans_have(spark):
    """Nine rows went through the shuffle for every point."""
    points = spark.createDataFrame([("a", 3), ("a", 40), ("b", 7)], "path string, at int")
    of = spark.createDataFrame([("a", 1, 5), ("a", 2, 2), ("a", 40, 1), ("b", 8, 9)], "path string, lo int, hi int")
    cells = spans._probing(points, of.filter("lo <= hi").select(spans._level(F.col("lo"), F.col("hi")).alias("level")), "at")
    assert cells.count() == 6 and {r["__level"] for r in cells.collect()} == {0, 1}
    assert [tuple(r) for r in spans.stab(points, of, ["path"], "at", "lo", "hi").collect()] == [("a", 3, 1, 5)]
    assert spans.stab(points, of.filter("lo > 100"), ["path"], "at", "lo", "hi").collect() == []


def test_usage_rows_are_counted_before_they_go_through_the_last_exchange(spark):
    """Every row went four times through one exchange, and its group through a second."""
    rows = [("t", k, f"p{i % 3}", "App", i, 1, i, 2) for i, k in enumerate(["read", "odd", "write", "read", "odd", "else", "read"])]
    refs = spark.createDataFrame(rows, "target_id string, usage_kind string, path string, project string, line int, column int, end_line int, end_column int")
    dims = {"file": "path", "project": "project", "usage-kind": "usage_kind"}
    found = usage.grouped_usage(refs, dims)
    assert _plan(found).split("Generate")[0].count("Exchange hashpartitioning") == 1
    whole = {(r["group_by"], r["key"]): (r["reference_count"], list(r["usage_kind_counts"].items()), r["line"]) for r in found.collect()}
    assert whole["project", "App"] == (7, [("read", 3), ("write", 1), ("else", 1), ("odd", 2)], 0)
    assert whole["file", "p1"] == (2, [("odd", 2)], 1)
    # A key of more rows than one task takes is spread, with the same result.
    assert sorted(map(str, usage.grouped_usage(refs, dims, hot=2).collect())) == sorted(map(str, found.collect()))


def test_texts_stream_by_the_places_asked_for(spark):
    """Texts were sorted, and met every target that asks for the same symbol."""
    targets = spark.createDataFrame([("t1", "s"), ("t2", "s"), ("t2", "s"), ("t3", "gone"), ("t4", None)], "target_id string, symbol_id string")
    decls = spark.createDataFrame([("s", "a.cs", 2, 3, False)], "symbol_id string, path string, line int, end_line int, is_metadata boolean")
    docs = spark.createDataFrame([("a.cs", "one\ntwo\nthree\nfour")], "path string, text string")
    found = budget.source_slices(targets, decls, docs, 40, 100)
    assert "ShuffledHashJoin" in _plan(found)
    got = sorted((r["target_id"], r["lines"], r["status"]) for r in found.collect())
    none = "source-location-not-found"
    assert got == [("t1", ["two", "three"], "ok"), ("t2", ["two", "three"], "ok"), ("t2", ["two", "three"], "ok"), ("t3", None, none), ("t4", None, none)]


def test_evidence_goes_through_one_exchange_before_files_are_cut(spark):
    """Evidence went through one exchange by place, one by file and one by target, and files once more for their number."""
    rows = [(f"t{i % 2}", f"p{i % 5}", i % 7, 1, i % 7, 2, reason, i % 3 == 0) for i in range(40) for reason in usage.FILE_REASONS[i % 3 : i % 3 + 2]]
    place = "path string, line int, `column` int, end_line int, end_column int"
    evidence = spark.createDataFrame([*rows, (None, "p1", 1, 1, 1, 2, usage.FILE_REASONS[0], True)], f"target_id string, {place}, reason string, direct boolean")
    ordered = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    got = usage.related_files(evidence, 3)
    assert {(r["target_id"], r["position"], r["total"], r["truncated"]) for r in got.collect()} == {(f"t{i}", n, 5, True) for i in range(2) for n in (1, 2, 3)}
    assert ordered(usage.related_files(evidence, 3, hot=4)) == ordered(got)
    plan = _plan(got)
    # By target and part, by target; the hash buckets are counted beside.
    assert plan.split("Subqueries")[0].count("Exchange hashpartitioning(target_id") == 2 and "hashpartitioning(path" not in plan


def test_a_round_of_a_walk_writes_only_what_it_found(spark, monkeypatch):
    """Every round wrote the whole state."""
    written = []

    def cut(df):
        df = cut_lineage(df)
        written.append(df.count() if "depth" in df.columns else 0)
        return df

    cut_lineage = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", cut)
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "s string, d string")
    seeds = spark.createDataFrame([("a", "n0"), ("a", "n6"), ("b", "n4"), ("c", "n6")], "target_id string, node string")
    found = {(r["target_id"], r["node"]): r["depth"] for r in graph.closure(edges, seeds, "s", "d").collect()}
    # Seeds are left out, also those that another seed reaches; a lone seed that no edge leaves is not walked.
    assert found == {("a", f"n{i}"): i for i in range(1, 6)} | {("b", "n5"): 1, ("b", "n6"): 2}
    assert sum(written) == len(found) + 3


def test_only_asked_relations_of_a_hierarchy_are_walked(spark):
    edges = spark.createDataFrame([("B", "A", "base"), ("C", "B", "base"), ("A", "I", "interface"), ("M", "N", "override")], "child_id string, parent_id string, edge_kind string")
    targets = spark.createDataFrame([(x, x) for x in "ABIMN"], "target_id string, symbol_id string")
    asked = ("derived-type", "implementing-type")
    whole = graph.type_hierarchy(targets, edges).filter(F.col("relation").isin(*asked))
    some = graph.type_hierarchy(targets, edges, asked)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(some) == rows(whole) and len(rows(some)) == 6


def test_hits_of_a_symbol_go_through_one_exchange(spark):
    """Hits went through four exchanges: for distinct lines, first lines, totals and kinds."""
    rows = [(f"c{i % 2}", f"S{i % 3}", "a.cs", ("body", "type-body")[i // 7 % 2], i // 2) for i in range(60)] * 2 + [(None, "S1", "a.cs", "body", 1)]
    hits = spark.createDataFrame(rows, "change_id string, symbol_id string, path string, change_kind string, changed_line int")
    want = {}
    for c, s, _, k, n in rows[:-1]:
        lines, kinds = want.setdefault((c, s), (set(), set()))
        lines.add(n)
        kinds.add(k)
    for hot in (1 << 20, 3):
        got = {(r["change_id"], r["symbol_id"]): r for r in spans.changed_symbol_rows(hits, 4, hot).collect()}
        assert got.keys() == want.keys()
        for key, (lines, kinds) in want.items():
            assert got[key]["total_lines"] == len(lines) and got[key]["changed_lines"] == sorted(lines)[:4]
            assert got[key]["change_kinds"] == sorted(kinds) and got[key]["lines_truncated"] == (len(lines) > 4)
    plan = _plan(spans.changed_symbol_rows(hits, 4)).split("Subqueries")[0]
    assert plan.count("Exchange hashpartitioning(change_id") == 2
