"""Review rules, findings, related tests, evaluation scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspan.operators import core, evals, filters, impact, review

from .registry import query

TASK = "System.Threading.Tasks.Task"
TOKEN = "System.Threading.CancellationToken"
# Calls are line items in the file of their order; methods are blocks of lines of that file.
CALL_SQL = """
SELECT concat('src/o', CAST(l_orderkey % 2000 AS {0}), '.cs') AS path, CAST(l_linenumber * 10 + l_partkey % 10 AS INT) AS line, CAST(l_suppkey AS INT) AS column_no, CAST(l_linenumber * 10 + l_partkey % 10 AS INT) AS end_line,
  CAST(l_suppkey + 8 AS INT) AS end_column, l_partkey AS pk, l_suppkey AS sk, CAST(l_quantity AS INT) AS q,
  CASE l_partkey % 8 WHEN 0 THEN 'Wait' WHEN 1 THEN 'GetResult' WHEN 2 THEN 'ExecuteSqlRaw' WHEN 3 THEN 'LogWarning' WHEN 4 THEN 'DeserializeJson' WHEN 5 THEN 'GetType' ELSE 'Run' END AS method_name FROM lineitem"""
METHOD_SQL = """
SELECT DISTINCT concat('src/o', CAST(l_orderkey % 2000 AS {0}), '.cs') AS path, CAST(l_linenumber * 10 AS INT) AS line, CAST(l_linenumber * 10 + 7 AS INT) AS end_line,
  concat('m', CAST(l_orderkey % 2000 AS {0}), '.', CAST(l_linenumber AS {0})) AS symbol, l_orderkey % 2000 AS k, l_linenumber AS n FROM lineitem"""


def calls(f):
    df = f.sql(CALL_SQL.format("STRING"))
    task, token = F.lit(TASK), F.lit(TOKEN)
    return (
        df.withColumn("owner_type", F.when(F.col("q") % 3 == 0, task).when(F.col("q") % 3 == 1, F.lit("System.Type")).otherwise(F.lit("X.JsonSerializer")))
        .withColumn("receiver_call", F.when(F.col("q") % 5 == 0, F.lit("GetAwaiter")))
        .withColumn("receiver_type", F.when(F.col("q") % 2 == 0, task))
        .withColumn("result_type", F.when(F.col("q") % 4 == 0, task).otherwise("void"))
        .withColumn("is_statement", F.col("sk") % 2 == 0)
        .withColumn("callee_param_types", F.when(F.col("q") % 6 == 0, F.array(F.lit("int"), token)).otherwise(F.array(F.lit("int"))))
        .withColumn("arg_types", F.when(F.col("sk") % 3 == 0, F.array(token)).otherwise(F.array(F.lit("int"))))
        .withColumn("has_built_string", F.col("sk") % 4 == 1)
        .withColumn("text", F.when(F.col("q") % 7 == 0, "x.Log(userPassword)").otherwise("x.Log(y)"))
        .withColumn("containing_symbol", F.col("method_name"))
    )


def methods(f):
    df = f.sql(METHOD_SQL.format("STRING"))
    return (
        df.withColumn("column", F.lit(1)).withColumn("end_column", F.lit(200)).withColumn("is_async", F.col("n") % 2 == 0).withColumn("returns_void", F.col("k") % 3 == 0)
        .withColumn("param_names", F.when(F.col("k") % 2 == 0, F.array(F.lit("sender"), F.lit("e"))).otherwise(F.array(F.lit("a"), F.lit("ct"))))
        .withColumn("param_types", F.when(F.col("k") % 2 == 0, F.array(F.lit("object"), F.lit("EventArgs"))).otherwise(F.array(F.lit("int"), F.lit(TOKEN))))
        .withColumn("type_name", F.when(F.col("k") % 10 == 0, "OController").otherwise("O"))
        .withColumn("attributes", F.array_compact(F.array(F.when(F.col("k") % 7 == 0, "HttpGetAttribute"), F.when(F.col("n") % 3 == 0, "AuthorizeAttribute"))))
        .withColumn("type_attributes", F.array_compact(F.array(F.when(F.col("k") % 20 == 0, "AllowAnonymous"))))
    )


ASYNC = f"""
calls AS ({CALL_SQL.format('VARCHAR')}), ms AS ({METHOD_SQL.format('VARCHAR')}),
raw AS (
  SELECT 'async.async-void' AS rule_id, path, line, 1 AS col FROM ms WHERE n % 2 = 0 AND k % 3 = 0 AND k % 2 <> 0
  UNION ALL SELECT 'async.cancellation-token-not-forwarded', c.path, c.line, c.column_no FROM calls c JOIN ms m ON m.path = c.path AND m.k % 2 = 1 AND ROW(c.line, c.column_no) >= ROW(m.line, 1) AND ROW(c.end_line, c.end_column) <= ROW(m.end_line, 200) WHERE q % 6 = 0 AND sk % 3 <> 0
  UNION ALL SELECT 'async.sync-over-async', path, line, column_no FROM calls WHERE (method_name IN ('Wait', 'GetResult') AND q % 3 = 0) OR (method_name = 'GetResult' AND q % 5 = 0 AND q % 2 = 0)
  UNION ALL SELECT 'async.fire-and-forget', path, line, column_no FROM calls WHERE q % 4 = 0 AND sk % 2 = 0
  UNION ALL SELECT 'async.sync-over-async', path, line, column_no FROM calls WHERE pk % 8 = 6 AND q % 3 = 0),
asyncf AS (SELECT DISTINCT rule_id, path, line, col, CASE rule_id WHEN 'async.async-void' THEN 'warning' WHEN 'async.sync-over-async' THEN 'warning' ELSE 'info' END AS severity,
  CASE rule_id WHEN 'async.async-void' THEN 'high' WHEN 'async.sync-over-async' THEN 'high' ELSE 'medium' END AS confidence FROM raw)"""


def async_findings(f):
    c = calls(f)
    props = c.filter(F.col("pk") % 8 == 6).withColumn("name", F.lit("Result"))
    return review.async_findings(methods(f), c, props)


@query("async_findings", "rule_id s, severity s, confidence s, path s, line i, column i", f"""
WITH {ASYNC}
SELECT_RESULT
SELECT rule_id, severity, confidence, path, line, col AS "column" FROM asyncf""")
def _(f):
    return async_findings(f)


SECURITY = f"""
calls AS ({CALL_SQL.format('VARCHAR')}), ms AS ({METHOD_SQL.format('VARCHAR')}),
secf AS (SELECT DISTINCT * FROM (
  SELECT 'security.auth-surface-signal' AS rule_id, path, line, 1 AS col FROM ms WHERE (k % 10 = 0 OR k % 7 = 0) AND n % 3 <> 0 AND k % 20 <> 0
  UNION ALL SELECT 'security.sql-string-construction', path, line, column_no FROM calls WHERE contains(lower(method_name), 'sql') AND sk % 4 = 1
  UNION ALL SELECT 'security.sql-string-construction', path, line, column_no FROM calls WHERE pk % 8 = 7 AND sk % 4 = 1
  UNION ALL SELECT 'security.file-process-reflection-signal', path, line, column_no FROM calls WHERE method_name = 'GetType' AND q % 3 = 1
  UNION ALL SELECT 'security.deserialization-signal', path, line, column_no FROM calls WHERE contains(lower(method_name), 'deserialize') OR q % 3 = 2
  UNION ALL SELECT 'security.sensitive-logging-signal', path, line, column_no FROM calls WHERE starts_with(method_name, 'Log') AND q % 7 = 0) x)"""


def security_findings(f):
    c = calls(f)
    creations = c.filter(F.col("pk") % 8 == 7).withColumn("type_name", F.lit("System.Data.SqlCommand"))
    return review.security_findings(methods(f), c, creations)


@query("security_findings", "rule_id s, path s, line i, column i", f"""
WITH {SECURITY}
SELECT_RESULT
SELECT rule_id, path, line, col AS "column" FROM secf""")
def _(f):
    return security_findings(f)


LOCALS = "SELECT concat('s', CAST(l_orderkey AS {0})) AS scope_id, concat('v', CAST(l_linenumber AS {0})) AS name, concat('T', CAST(l_suppkey % 10 AS {0})) AS type_id, l_partkey % 3 = 0 AS is_using, l_partkey % 2 = 0 AS is_await_using, concat('src/', CAST(l_orderkey AS {0}), '.cs') AS path, CAST(l_linenumber AS INT) AS line, CAST(l_partkey AS INT) AS column_no FROM lineitem"


@query("disposal_findings", "rule_id s, path s, line i, column i", f"""
WITH l AS ({LOCALS.format('VARCHAR')}), u AS (SELECT DISTINCT concat('s', CAST(o_orderkey AS VARCHAR)) AS scope_id, concat('v', CAST(o_custkey % 7 AS VARCHAR)) AS name FROM orders)
SELECT_RESULT
SELECT DISTINCT 'disposal.async-disposable-sync-dispose' AS rule_id, path, line, column_no AS "column" FROM l WHERE is_using AND NOT is_await_using AND type_id IN ('T1', 'T2')
UNION ALL SELECT DISTINCT 'disposal.created-disposable-not-disposed', path, line, column_no FROM l WHERE NOT is_using AND type_id IN ('T2', 'T3', 'T4') AND NOT EXISTS (SELECT 1 FROM u WHERE u.scope_id = l.scope_id AND u.name = l.name)""")
def _(f):
    locals_ = f.sql(LOCALS.format("STRING")).withColumn("containing_symbol", F.col("scope_id")).withColumn("end_line", F.col("line")).withColumn("end_column", F.col("column"))
    interfaces = f.sql(
        "SELECT concat('T', CAST(r_regionkey AS STRING)) AS type_id, 'System.IAsyncDisposable' AS interface_name FROM region WHERE r_regionkey IN (1, 2) UNION ALL "
        "SELECT concat('T', CAST(r_regionkey AS STRING)), 'System.IDisposable' FROM region WHERE r_regionkey > 1"
    )
    uses = f.sql("SELECT concat('s', CAST(o_orderkey AS STRING)) AS scope_id, concat('v', CAST(o_custkey % 7 AS STRING)) AS name, CASE o_orderkey % 3 WHEN 0 THEN 'dispose' WHEN 1 THEN 'return' ELSE 'assign' END AS use_kind FROM orders")
    return review.disposal_findings(locals_, interfaces, uses)


@query("nullability_findings", "rule_id s, path s, line i, column i", """
WITH off AS (SELECT DISTINCT concat(CASE WHEN s_suppkey % 17 < 4 THEN 'App.Tests' ELSE 'App' END, CAST(s_suppkey % 17 AS VARCHAR)) AS project FROM supplier WHERE s_suppkey % 17 < 9),
pub AS (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY line, column_no, symbol_id) AS rn FROM f_decls WHERE accessibility IN ('Public', 'Protected') AND kind IN ('NamedType', 'Method') AND project IN (SELECT project FROM off))
SELECT_RESULT
SELECT DISTINCT 'nullability.null-forgiving' AS rule_id, path, line, column_no AS "column" FROM f_refs WHERE usage_kind = 'other'
UNION ALL SELECT DISTINCT 'nullability.oblivious-public-api', path, line, column_no FROM pub WHERE rn <= 2
UNION ALL SELECT DISTINCT 'nullability.required-member-signal', path, line, column_no FROM f_decls WHERE kind = 'Property' AND accessibility = 'Public'""")
def _(f):
    ops = f.f_refs.withColumn("operator", F.when(F.col("usage_kind") == "other", "!").otherwise(".")).withColumn("containing_symbol", F.col("target_symbol_id"))
    decls = f.f_decls.withColumn("modifiers", F.when(F.col("accessibility") == "Public", F.array(F.lit("required"))).otherwise(F.array().cast("array<string>")))
    projects = f.sql(
        "SELECT concat(CASE WHEN s_suppkey % 17 < 4 THEN 'App.Tests' ELSE 'App' END, CAST(s_suppkey % 17 AS STRING)) AS project, CASE WHEN s_suppkey % 17 < 9 THEN 'disable' ELSE 'enable' END AS nullable FROM supplier"
    )
    return review.nullability_findings(ops, decls, projects, symbol_limit=2)


RULES = """
SELECT concat('rule', CAST(n_nationkey AS {0})) AS id, CASE n_nationkey % 3 WHEN 0 THEN 'project-dependency' WHEN 1 THEN 'namespace-dependency' ELSE 'layer-dependency' END AS kind, concat('C', CAST(n_nationkey AS {0})) AS from_pattern, n_nationkey AS k FROM nation"""
IMPORTS = """
SELECT concat('src/', CAST(o_orderkey AS {0}), '.cs') AS path, CAST(o_orderkey AS INT) AS line, 1 AS column_no, concat('C', CAST(o_custkey % 40 AS {0}), CASE WHEN o_orderkey % 2 = 0 THEN '.Sub.Deep' ELSE '' END) AS from_namespace,
  concat('P', substr(o_orderpriority, 1, 1), CASE WHEN o_orderkey % 3 = 0 THEN '.Inner' ELSE 'x' END) AS namespace FROM orders"""


def rules(f):
    df = f.sql(RULES.format("STRING"))
    return df.withColumn("disallow", F.when(F.col("kind") == "project-dependency", F.array(F.concat(F.lit("D"), (F.col("k") % 5).cast("string")), F.lit("libs/D9.csproj"))).otherwise(
        F.array(F.concat(F.lit("P"), (F.col("k") % 5 + 1).cast("string")), F.lit("Px"))
    )).drop("k")


@query("namespace_rule_violations", "rule s, rule_kind s, path s, namespace s", f"""
WITH r AS ({RULES.format('VARCHAR')}), i AS ({IMPORTS.format('VARCHAR')})
SELECT_RESULT
SELECT id AS rule, kind AS rule_kind, path, namespace FROM i JOIN r ON kind <> 'project-dependency' AND (from_namespace = from_pattern OR starts_with(from_namespace, concat(from_pattern, '.')))
  AND (namespace = concat('P', CAST(k % 5 + 1 AS VARCHAR)) OR starts_with(namespace, concat('P', CAST(k % 5 + 1 AS VARCHAR), '.')) OR namespace = 'Px')""")
def _(f):
    return review.namespace_rule_violations(f.sql(IMPORTS.format("STRING")), rules(f))


@query("project_rule_violations", "rule s, from_name s, to_name s", f"""
WITH r AS ({RULES.format('VARCHAR')}), e AS (SELECT DISTINCT concat('C', CAST(o_custkey % 40 AS VARCHAR)) AS from_name, concat('D', CAST(o_orderkey % 10 AS VARCHAR)) AS to_name FROM orders)
SELECT_RESULT
SELECT id AS rule, from_name, to_name FROM e JOIN r ON kind = 'project-dependency' AND from_name = from_pattern AND (to_name = concat('D', CAST(k % 5 AS VARCHAR)) OR to_name = 'D9')""")
def _(f):
    edges = f.sql("SELECT DISTINCT concat('C', CAST(o_custkey % 40 AS STRING)) AS from_name, concat('D', CAST(o_orderkey % 10 AS STRING)) AS to_name FROM orders")
    edges = edges.withColumn("from_path", F.lit(None).cast("string")).withColumn("to_path", F.concat(F.lit("libs/"), "to_name", F.lit(".csproj")))
    return review.project_rule_violations(edges, rules(f))


FOUND = f"""{ASYNC}, secf AS {SECURITY.split("secf AS", 1)[1]},
allf AS (SELECT rule_id, path, line, col, severity, confidence, 'async' AS pack FROM asyncf UNION ALL SELECT rule_id, path, line, col, CASE WHEN rule_id IN ('security.sql-string-construction', 'security.sensitive-logging-signal') THEN 'warning' ELSE 'info' END, 'medium', 'security' FROM secf)"""


def findings(f):
    return async_findings(f).unionByName(security_findings(f))


@query("order_findings", "position i, rule_id s, path s, line i, total i, truncated b", f"""
WITH {FOUND}, placed AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'warning' THEN 1 ELSE 2 END, CASE confidence WHEN 'high' THEN 0 ELSE 1 END, pack, rule_id, path, line, col) AS position, count(*) OVER () AS total FROM allf)
SELECT_RESULT
SELECT position, rule_id, path, line, total, total > 200 AS truncated FROM placed WHERE position <= 200""")
def _(f):
    return review.order_findings(findings(f), 200)


@query("finding_summary", "facet s, key s, finding_count i, worst_severity s", f"""
WITH {FOUND}
SELECT_RESULT
SELECT 'pack' AS facet, pack AS key, count(*) AS finding_count, NULL AS worst_severity FROM allf GROUP BY pack UNION ALL SELECT 'severity', severity, count(*), NULL FROM allf GROUP BY severity
UNION ALL SELECT 'confidence', confidence, count(*), NULL FROM allf GROUP BY confidence UNION ALL SELECT 'rule', rule_id, count(*), CASE WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END FROM allf GROUP BY rule_id""")
def _(f):
    return review.finding_summary(findings(f))


# Tests are conversation turns; subjects are benchmark items named by a word of their text.
TESTS = """
SELECT DISTINCT concat(role, CAST(turn AS {0}), split_part(text, ' ', 2)) AS name, concat('Suite.', split_part(text, ' ', 3)) AS container, concat('App', CAST(conv_id % 5 AS {0})) AS project,
  concat('tests/', CAST(conv_id AS {0}), '/', split_part(text, ' ', 5), '.cs') AS path, CAST(turn AS INT) AS line, CAST(conv_id % 4 AS INT) AS ak FROM conversations"""
SUBJECTS = """
SELECT concat('b', CAST(item_id AS {0})) AS subject_id, substr(split_part(text, ' ', 6), 1, 3) AS name, CASE WHEN item_id % 2 = 0 THEN 'NamedType' ELSE 'Method' END AS kind, concat('N.', replace(substr(split_part(text, ' ', 8), 1, 4), '.', '')) AS container FROM benchmark"""
RANKED = f"""
t AS (SELECT *, CASE ak WHEN 0 THEN 'xunit' WHEN 1 THEN 'nunit' ELSE 'mstest' END AS framework FROM ({TESTS.format('VARCHAR')}) x WHERE ak < 3), s AS ({SUBJECTS.format('VARCHAR')}),
refs AS (SELECT DISTINCT concat('b', CAST(conv_id % 40 AS VARCHAR)) AS subject_id, concat('tests/', CAST(conv_id AS VARCHAR), '/', split_part(text, ' ', 5), '.cs') AS path FROM conversations),
marks AS (SELECT subject_id, t.*, EXISTS (SELECT 1 FROM refs r WHERE r.subject_id = s.subject_id AND r.path = t.path) AS m1,
   s.tn <> '' AND (contains(lower(t.container), s.tn) OR contains(lower(t.name), s.tn)) AS m2, s.nn <> '' AND contains(lower(t.path), s.nn) AS m3
  FROM (SELECT subject_id, lower(CASE WHEN kind = 'NamedType' THEN name ELSE substr(container, 3) END) AS tn, lower(name) AS nn FROM s) s, t),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, project, path, line, name ORDER BY framework) AS rn FROM marks WHERE m1 OR m2 OR m3) x),
ranked AS (SELECT subject_id, project, path, line, name, arg_min(framework, framework) AS framework, bool_or(m1) AS m1, bool_or(m2) AS m2, bool_or(m3) AS m3 FROM best GROUP BY ALL),
scored AS (SELECT *, 10 + CASE WHEN m1 THEN 80 ELSE 0 END + CASE WHEN m2 THEN 40 ELSE 0 END + CASE WHEN m3 THEN 30 ELSE 0 END AS score, CASE WHEN m1 THEN 'high' ELSE 'medium' END AS confidence FROM ranked)"""


def tests(f):
    df = f.sql(TESTS.format("STRING")).withColumn("column", F.lit(1)).withColumn("end_line", F.col("line")).withColumn("end_column", F.lit(9))
    attrs = F.when(F.col("ak") == 0, F.array(F.lit("Obsolete"), F.lit("Xunit.FactAttribute"))).when(F.col("ak") == 1, F.array(F.lit("TestCase"))).when(
        F.col("ak") == 2, F.array(F.lit("DataTestMethodAttribute"))
    ).otherwise(F.array(F.lit("Fake")))
    return filters.discover_tests(df.withColumn("attributes", attrs))


def ranked_tests(f):
    refs = f.sql("SELECT concat('b', CAST(conv_id % 40 AS STRING)) AS subject_id, concat('tests/', CAST(conv_id AS STRING), '/', split_part(text, ' ', 5), '.cs') AS path FROM conversations")
    return impact.rank_tests(tests(f), f.sql(SUBJECTS.format("STRING")), refs)


@query("discover_tests", "project s, path s, line i, name s, framework s, score i", f"""
WITH {RANKED}
SELECT_RESULT
SELECT project, path, line, name, framework, 10 AS score FROM t""")
def _(f):
    return tests(f)


@query("rank_tests", "subject_id s, project s, path s, line i, name s, score i, confidence s, reason_codes a", f"""
WITH {RANKED}
SELECT_RESULT
SELECT subject_id, project, path, line, name, score, confidence, list_filter([CASE WHEN m1 THEN 'direct-reference-to-symbol' END, 'test-method-attribute', CASE WHEN m2 THEN 'test-class-name-convention' END, CASE WHEN m3 THEN 'test-file-name-convention' END], lambda x: x IS NOT NULL) AS reason_codes FROM scored""")
def _(f):
    return ranked_tests(f)


@query("tests_for_subjects", "subject_id s, position i, path s, name s, score i, total i, truncated b", f"""
WITH {RANKED}, placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence, score DESC, project, path, line, name) AS position, count(*) OVER (PARTITION BY subject_id) AS total FROM scored)
SELECT_RESULT
SELECT subject_id, position, path, name, score, total, total > 5 AS truncated FROM placed WHERE position <= 5""")
def _(f):
    return impact.tests_for_subjects(ranked_tests(f), 5)


@query("best_test_per_change", "change_id s, path s, name s, score i, subject_id s", f"""
WITH {RANKED}, c AS (SELECT concat('c', CAST(item_id % 5 AS VARCHAR)) AS change_id, concat('b', CAST(item_id AS VARCHAR)) AS subject_id FROM benchmark),
placed AS (SELECT change_id, s.*, row_number() OVER (PARTITION BY change_id, project, path, line, name ORDER BY confidence, score DESC, s.subject_id) AS rn FROM c JOIN scored s ON s.subject_id = c.subject_id)
SELECT_RESULT
SELECT change_id, path, name, score, subject_id FROM placed WHERE rn = 1""")
def _(f):
    changes = f.sql("SELECT concat('c', CAST(item_id % 5 AS STRING)) AS change_id, concat('b', CAST(item_id AS STRING)) AS subject_id FROM benchmark")
    return impact.best_test_per_change(ranked_tests(f), changes)


@query("latency_summary", "scenario s, sample_count i, maximum d, median d, p95 d", """
SELECT event_type AS scenario, count(value) AS sample_count, max(value) AS maximum, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""")
def _(f):
    return evals.latency_summary(f.events.withColumnRenamed("event_type", "scenario"), value="value")


@query("eval_summary", "user_id i, total i, passed_count i, score d, value_sum i, value_max i, value_median i, flagged_count i", """
SELECT user_id, count(*) AS total, count(*) FILTER (value > 10) AS passed_count, round(count(*) FILTER (value > 10) / count(*), 4) AS score, sum(event_id % 1000) AS value_sum, max(event_id % 1000) AS value_max,
 quantile_disc(event_id % 1000, 0.5) AS value_median, count(*) FILTER (event_type = 'error') AS flagged_count FROM events GROUP BY user_id""")
def _(f):
    df = f.sql("SELECT user_id, value > 10 AS passed, event_id % 1000 AS elapsed, event_type = 'error' AS flagged FROM events")
    return evals.eval_summary(df, ["user_id"])


# Scenarios are users; a trace is what a user's first three events were; some users have none.
TRACES = """
tr AS (SELECT user_id, list(event_type ORDER BY event_id) AS seq, max(event_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) e WHERE rn <= 3 AND user_id % 10 <> 9 GROUP BY user_id),
sc AS (SELECT DISTINCT user_id AS id FROM events),
card AS (SELECT id, coalesce(seq[1] IN ('view', 'click'), false) AS first_step_ok, CASE WHEN id % 3 = 0 THEN coalesce(last % 2 = 0, false) WHEN id % 3 = 1 THEN NOT coalesce(last % 2 = 0, false) ELSE true END AS identity_ok,
  NOT coalesce(list_contains(seq, 'error'), false) AND coalesce(len(seq), 0) <= 3 - id % 2 AS breadth_ok, coalesce(last % 3 <> 1, false) AS stop_ok, coalesce(last % 5 <> 0 AND last % 7 <> 0, false) AS output_ok FROM sc LEFT JOIN tr ON tr.user_id = sc.id)"""


def card(f):
    first = core.top_per_group(f.events, ["user_id"], ["event_id"], 3).filter("user_id % 10 <> 9")
    traces = first.groupBy(F.col("user_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("chosen_sequence"), F.max("event_id").alias("last")
    )
    traces = (
        traces.withColumn("stop_condition", F.when(F.col("last") % 3 == 0, "done").when(F.col("last") % 3 == 2, "asked").otherwise("ran-out"))
        .withColumn("used_tool", F.col("last") % 2 == 0).withColumn("stdout_valid", F.col("last") % 5 != 0).withColumn("stderr_clean", F.col("last") % 7 != 0).drop("last")
    )
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    scenarios = (
        f.events.select(F.col("user_id").alias("id")).distinct().withColumn("expected_first_steps", words("view", "click")).withColumn("avoid_tools", words("error"))
        .withColumn("accepted_stop_conditions", words("done", "asked")).withColumn("max_tool_count", F.lit(3) - F.col("id") % 2)
        .withColumn("identity_required", F.col("id") % 3 == 0).withColumn("tool_expected", F.col("id") % 3 == 2)
    )
    return evals.trace_scorecard(scenarios, traces)


@query("trace_scorecard", "id i, first_step_ok b, identity_ok b, breadth_ok b, stop_ok b, output_ok b, points i, passed b", f"""
WITH {TRACES}
SELECT_RESULT
SELECT *, CAST(first_step_ok AS INT) + CAST(identity_ok AS INT) + CAST(breadth_ok AS INT) + CAST(stop_ok AS INT) + CAST(output_ok AS INT) AS points, first_step_ok AND identity_ok AND breadth_ok AND stop_ok AND output_ok AS passed FROM card""")
def _(f):
    return card(f)


@query("scorecard_total", "total_points i, max_points i, score d, passed b", f"""
WITH {TRACES}, p AS (SELECT CAST(first_step_ok AS INT) + CAST(identity_ok AS INT) + CAST(breadth_ok AS INT) + CAST(stop_ok AS INT) + CAST(output_ok AS INT) AS points FROM card)
SELECT_RESULT
SELECT sum(points) AS total_points, count(*) * 5 AS max_points, round(sum(points) / (count(*) * 5), 4) AS score, round(sum(points) / (count(*) * 5), 4) >= 0.5 AS passed FROM p""")
def _(f):
    return evals.scorecard_total(card(f), 0.5)


@query("trace_gates", "user_id i, trace_count i, false_positive_rate d, broad_rate d, unanchored_edits i, stop_rate d, canonical_p95 i, canonical_max i, score d, passed b", """
WITH t AS (SELECT user_id, event_type = 'click' AS text_only, event_id % 3 = 0 AS used, event_id % 10 = 0 AS broad, event_id % 4 <> 0 AS anchored, event_id % 5 <> 0 AS stopped, event_type IN ('view', 'purchase') AS canonical, event_id % 3000 AS chars FROM events),
m AS (SELECT user_id, count(*) AS trace_count, CASE WHEN count(*) FILTER (text_only) = 0 THEN 0 ELSE round(count(*) FILTER (text_only AND used) / count(*) FILTER (text_only), 4) END AS false_positive_rate,
 round(count(*) FILTER (broad) / count(*), 4) AS broad_rate, count(*) FILTER (NOT anchored) AS unanchored_edits, round(count(*) FILTER (stopped) / count(*), 4) AS stop_rate,
 coalesce(quantile_disc(chars, 0.95) FILTER (canonical AND chars > 0), 0) AS canonical_p95, coalesce(max(chars) FILTER (canonical AND chars > 0), 0) AS canonical_max FROM t GROUP BY user_id),
p AS (SELECT *, CAST(false_positive_rate <= 0.3 AS INT) + CAST(broad_rate <= 0.12 AS INT) + CAST(unanchored_edits <= 60 AS INT) + CAST(stop_rate >= 0.78 AS INT) + CAST(canonical_p95 <= 2800 AS INT) + CAST(canonical_max <= 2990 AS INT) AS n FROM m)
SELECT_RESULT
SELECT * EXCLUDE (n), round(n / 6, 4) AS score, n = 6 AS passed FROM p""")
def _(f):
    df = f.sql(
        "SELECT user_id, CASE WHEN event_type = 'click' THEN 'text-only' ELSE 'code' END AS kind, CASE WHEN event_type IN ('view', 'purchase') THEN 'canonical' ELSE 'other' END AS surface, event_id % 3 = 0 AS used_tool, "
        "event_id % 10 = 0 AS broad_checklist, event_id % 4 <> 0 AS anchor_before_edit, CASE WHEN event_id % 5 <> 0 THEN 'done' ELSE ' ' END AS stop_condition, event_id % 3000 AS stdout_chars FROM events"
    )
    bounds = {"text_only": 0.3, "broad": 0.12, "unanchored": 60, "stop": 0.78, "p95_chars": 2800, "max_chars": 2990}
    return evals.trace_gates(df, bounds, 0.8, ["user_id"])


ADOPTION = """
WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS repo, c_custkey % 11 <> 0 AS cloned FROM customer),
a AS (SELECT CAST(o_custkey AS VARCHAR) AS repo, o_orderkey % 4 = 0 AS fb, max(ROW(o_orderkey % 5 <> 0 AND fits, o_orderkey % 3 <> 0 AND fits, o_orderkey % 2 = 0 AND fits)) AS m FROM (SELECT *, o_orderkey % 3 <> 1 AND o_orderkey < 3 * o_custkey AS fits FROM orders) o GROUP BY ALL),
j AS (SELECT r.repo, cloned, p.m AS pm, x.m AS xm FROM r LEFT JOIN a p ON p.repo = r.repo AND NOT p.fb LEFT JOIN a x ON x.repo = r.repo AND x.fb),
u AS (SELECT *, pm IS NOT NULL AND xm IS NOT NULL AND NOT pm[3] AND (xm[3] OR (NOT pm[2] AND xm[2])) AS used FROM j),
e AS (SELECT *, CASE WHEN used THEN xm ELSE pm END AS m FROM u),
status AS (SELECT repo, CASE WHEN NOT cloned THEN 'clone-failed' WHEN coalesce(m[1] AND m[2] AND m[3], false) THEN 'clean-success' WHEN coalesce(m[2], false) THEN 'degraded-target-success' ELSE 'no-go' END AS status, used AS used_fallback FROM e)"""


@query("adoption_status", "repo s, status s, used_fallback b", f"""{ADOPTION}
SELECT_RESULT
SELECT * FROM status""")
def _(f):
    return _adoption(f)


def _adoption(f):
    repos = f.sql("SELECT CAST(c_custkey AS STRING) AS repo, c_custkey % 11 <> 0 AS cloned FROM customer")
    attempts = f.sql(
        "SELECT CAST(o_custkey AS STRING) AS repo, CASE WHEN o_orderkey % 4 = 0 THEN 'fallback' ELSE 'primary' END AS role, o_orderkey % 5 <> 0 AND fits AS doctor_ok, o_orderkey % 3 <> 0 AND fits AS target_ok, o_orderkey % 2 = 0 AND fits AS prepare_ok "
        "FROM (SELECT *, o_orderkey % 3 <> 1 AND o_orderkey < 3 * o_custkey AS fits FROM orders) o"
    )
    return evals.adoption_status(repos, attempts)


@query("adoption_counts", "status s, repositories i", f"""{ADOPTION}
SELECT_RESULT
SELECT status, count(*) AS repositories FROM status GROUP BY status""")
def _(f):
    return evals.adoption_counts(_adoption(f))


LEDGER = """
SELECT concat('t', CAST(c_custkey AS {0})) AS target_id, c_custkey % 4 <> 0 AS selected, CASE c_custkey % 4 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN c_custkey % 4 = 0 THEN 'ambiguous-candidates' END AS ambiguity_reason, c_custkey % 3 AS total_candidates FROM customer"""


@query("confidence_ledger", "target_id s, overall s, evidence a, risk_level s, risk_reasons a, known_unknowns a", f"""
WITH t AS ({LEDGER.format('VARCHAR')}),
o AS (SELECT concat('t', CAST(o_custkey AS VARCHAR)) AS target_id, count(*) AS n, bool_or(o_totalprice > 480000) AS cut, count(*) FILTER (o_orderstatus = 'P') AS tests FROM orders GROUP BY ALL),
j AS (SELECT t.*, n, coalesce(cut, false) AS cut, coalesce(tests, 0) AS tests, o.target_id IS NOT NULL AND t.total_candidates > 0 AS src FROM t LEFT JOIN o ON o.target_id = t.target_id)
SELECT_RESULT
SELECT target_id, CASE WHEN selected THEN confidence ELSE 'none' END AS overall,
 [CASE WHEN selected THEN concat('target-selected/raises/', confidence, '/selected-target-present') ELSE concat('target-not-selected/lowers/high/', ambiguity_reason) END,
  CASE WHEN src THEN 'source-slice/raises/medium/bounded-source-returned' ELSE 'source-slice-missing/lowers/high/source-not-available' END,
  CASE WHEN coalesce(n, 0) > 0 THEN concat('context-pack/raises/medium/context-items:', CAST(n AS VARCHAR)) ELSE 'context-pack-empty/neutral/medium/context-items:0' END,
  CASE WHEN tests > 0 THEN concat('related-tests/raises/medium/test-candidates:', CAST(tests AS VARCHAR)) ELSE 'related-tests-empty/neutral/medium/test-candidates:0' END] AS evidence,
 CASE WHEN NOT selected THEN 'high' WHEN cut THEN 'medium' ELSE 'low' END AS risk_level,
 list_sort(list_filter([CASE WHEN NOT selected THEN 'no-selected-target' END, ambiguity_reason, CASE WHEN cut THEN 'context-truncated' END, CASE WHEN tests = 0 THEN 'no-related-tests-found' END], lambda x: x IS NOT NULL)) AS risk_reasons,
 list_sort(list_filter([CASE WHEN total_candidates > 1 THEN 'multiple-candidates-existed-before-selection' END, CASE WHEN cut THEN 'context-pack-truncated-by-budget' END, CASE WHEN tests = 0 THEN 'related-tests-not-proven' END, 'runtime-behavior-not-proven'], lambda x: x IS NOT NULL)) AS known_unknowns FROM j""")
def _(f):
    asked = f.sql(LEDGER.format("STRING"))
    per = f.sql(
        "SELECT concat('t', CAST(o_custkey AS STRING)) AS target_id, count(*) AS item_count, bool_or(o_totalprice > 480000) AS truncated, count_if(o_orderstatus = 'P') AS test_count FROM orders GROUP BY o_custkey"
    )
    sources = per.join(asked.filter("total_candidates > 0").select("target_id"), "target_id").withColumn("status", F.lit("ok"))
    ledger = evals.confidence_ledger(asked, sources, per, per)
    flat = F.transform("evidence", lambda e: F.concat_ws("/", e["code"], e["effect"], e["confidence"], e["reason"]))
    return ledger.withColumn("evidence", flat)
