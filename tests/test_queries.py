"""A sample of the registered queries against their SQL counterparts on the smallest tables (tools/check.py runs all)."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import connect, rows_of  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "name_functions", "select_candidate", "grouped_usage", "type_hierarchy", "upstream_chains", "symbols_in_range", "diagnostics_in_span",
    "apply_budget", "source_slices", "api_changes", "edit_guard", "di_risks", "routes", "namespace_rule_violations", "rank_tests", "trace_scorecard", "parse_diff_hunks",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    df = queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(FOLDER).execute(oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_every_query_is_registered_once():
    assert len(queries()) > 100 and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[0] == "target_id"
