import pytest
from pyspark.sql import functions as F

from factspan.operators import filters, ranking, usage
from factspan.plans import lookup

LOCS = "path string, line int, column int, end_line int, end_column int"
DECLS = [
    ("EnemyManager", "NamedType", "Alpha", 3), ("Spawn", "Method", "Alpha.EnemyManager", 5), ("Helper", "Method", "Alpha.EnemyManager", 10),
    ("NestedEnemy", "NamedType", "Alpha.EnemyManager", 14), ("EnemyManager", "NamedType", "Alpha", 19), ("Count", "Property", "Alpha.EnemyManager", 21),
    ("EnemyManagerTools", "NamedType", "Alpha", 24), ("Use", "Method", "Alpha.EnemyManagerTools", 26), ("EnemyManager", "Method", "Alpha.EnemyManagerTools", 31),
    ("Spawner", "NamedType", "Alpha", 36), ("Run", "Method", "Alpha.Spawner", 38), ("EnemyManager", "NamedType", "Beta", 48), ("enemyManager", "NamedType", "Beta", 52),
]


@pytest.fixture(scope="module")
def decls(spark):
    rows = [(f"s{line}", n, k, c, f"{c}.{n}", "FixtureCode.cs", line, 1, line, 20) for n, k, c, line in DECLS]
    return spark.createDataFrame(rows, f"symbol_id string, name string, kind string, container string, fqn string, {LOCS}")


def ask(spark, query, kinds=(), match="smart", case_sensitive=False):
    schema = "target_id string, query string, match string, case_sensitive boolean, assume_kinds array<string>"
    return spark.createDataFrame([("t", query, match, case_sensitive, list(kinds))], schema)


def choose(spark, decls, *args, **kwargs):
    targets = ask(spark, *args, **kwargs)
    return lookup.find(targets, decls)["choice"].collect()[0]


def test_single_candidate_is_high(spark, decls):
    row = choose(spark, decls, "EnemyManagerTools", ["NamedType"])
    assert (row.confidence, row.selection_reason, row.symbol_id) == ("high", "single-candidate", "s24")


def test_several_exact_candidates_are_ambiguous(spark, decls):
    row = choose(spark, decls, "EnemyManager", ["NamedType"])
    assert row.confidence == "ambiguous" and row.symbol_id is None and row.total_candidates >= 2


def test_exact_beats_contains_with_medium(spark, decls):
    row = choose(spark, decls, "Spawn", ["Method"])
    assert (row.confidence, row.symbol_id, row.total_candidates) == ("medium", "s5", 2)


def test_unknown_name_has_no_candidates(spark, decls):
    row = choose(spark, decls, "Absent")
    assert (row.confidence, row.total_candidates, row.selected) == ("none", 0, False)


def test_short_and_normalized_queries(spark, decls):
    assert choose(spark, decls, "un").total_candidates == 2  # Count, Run
    row = choose(spark, decls, "nested-enemy!")
    assert (row.confidence, row.symbol_id) == ("high", "s14")


def test_regex_targets(spark, decls):
    ranked = ranking.rank_candidates(ask(spark, "^Sp.*n", match="regex"), decls, with_regex=True)
    assert {r.symbol_id for r in ranked.collect()} == {"s5", "s36"}


def test_name_modes(spark):
    df = spark.createDataFrame([("DefaultWidgetFormatter",), ("Widget",), ("widget",), (None,)], "name string")
    count = lambda *a: filters.name_filter(df, *a).count()
    assert count("widget", "contains") == 3
    assert count("Widget", "exact", True) == 1
    assert count("^w", "regex", True) == 1
    with pytest.raises(Exception):
        count("[", "regex")


def test_regex_text_contains_matches_brute_force(spark):
    words = ["alpha", "alp", "lph", "a", "ph", "xyz", "banana", "nana", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    found = {tuple(r) for r in ranking.text_contains(df, df, "w", "w").collect()}
    assert found == {(n, t) for n in words for t in words if n and n in t}


def test_where_used_counts(spark, decls):
    refs = spark.createDataFrame(
        [("s5", "invoke", "App", "FixtureCode.cs", 28, 5, 28, 10), ("s5", "invoke", "App", "FixtureCode.cs", 40, 5, 40, 10), ("s5", "invoke", "App", "FixtureCode.cs", 40, 5, 40, 10)],
        f"target_symbol_id string, usage_kind string, project string, {LOCS}",
    )
    chosen = spark.createDataFrame([("t", "s5")], "target_id string, symbol_id string")
    found = lookup.where_used(chosen, refs, decls, {"file": "path"})
    assert found["references"].count() == 2
    assert [tuple(r)[:3] for r in found["counts"].collect()] == [("t", "invoke", 2)]
    group = found["groups"].collect()[0]
    assert (group.key, group.reference_count, group.usage_kind_counts, group.line) == ("FixtureCode.cs", 2, {"invoke": 2}, 28)


def test_usage_null_project_is_unknown(spark):
    refs = spark.createDataFrame([("t", "read", None, "a", 1, 1, 1, 2)], f"target_id string, usage_kind string, project string, {LOCS}")
    assert usage.grouped_usage(refs, {"project": "project"}).collect()[0].key == "unknown"
