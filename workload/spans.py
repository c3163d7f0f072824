"""Positions, intervals, changed lines, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspan.operators import core, filters, spans, usage

from .registry import query

FULL = "path, line, column_no, end_line, end_column, severity, id, message"
INNER = """
inner_hits AS (
  SELECT p.path, p.line, min(ROW(s.end_line - s.line, s.symbol_id, s.kind)) AS best FROM (SELECT DISTINCT path, line FROM f_points) p
  JOIN f_spans s ON s.path = p.path AND p.line BETWEEN s.line AND s.end_line GROUP BY p.path, p.line)"""
HITS = """
changed AS (SELECT DISTINCT change_id, path, unnest(range(new_start, new_start + new_count)) AS changed_line FROM f_hunks WHERE new_count > 0),
hit AS (
  SELECT c.change_id, c.path, c.changed_line, min(ROW(s.end_line - s.line, s.symbol_id, s.kind)) AS best FROM changed c
  JOIN f_spans s ON s.path = c.path AND c.changed_line BETWEEN s.line AND s.end_line WHERE changed_line >= 1 GROUP BY ALL),
hits AS (SELECT change_id, best[2] AS symbol_id, path, CASE WHEN best[3] = 'NamedType' THEN 'type-body' ELSE 'body' END AS change_kind, changed_line FROM hit)"""


@query("enclosing_declaration", "event_id i, symbol_id s, kind s", f"""
WITH {INNER}
SELECT_RESULT
SELECT event_id, best[2] AS symbol_id, best[3] AS kind FROM f_points p LEFT JOIN inner_hits h ON h.path = p.path AND h.line = p.line""")
def _(f):
    found = spans.enclosing_declaration(f.f_points, f.f_spans, payload=("symbol_id", "kind"))
    return found.select("event_id", F.col("containing_symbol_id").alias("symbol_id"), F.col("containing_kind").alias("kind"))


def hits(f):
    return spans.changed_declarations(f.f_hunks, f.f_spans)


@query("changed_declarations", "change_id s, symbol_id s, path s, change_kind s, changed_line i", f"""
WITH {HITS}
SELECT_RESULT
SELECT * FROM hits""")
def _(f):
    return hits(f)


@query("changed_symbol_rows", "change_id s, symbol_id s, change_kinds a, total_lines i, shown i, first i, last_shown i, lines_truncated b", f"""
WITH {HITS}, lines AS (SELECT change_id, symbol_id, list_sort(list_distinct(list(change_kind))) AS change_kinds, list_sort(list_distinct(list(changed_line))) AS l FROM hits GROUP BY change_id, symbol_id)
SELECT_RESULT
SELECT change_id, symbol_id, change_kinds, len(l) AS total_lines, least(len(l), 25) AS shown, l[1] AS first, l[least(len(l), 25)] AS last_shown, len(l) > 25 AS lines_truncated FROM lines""")
def _(f):
    rows = spans.changed_symbol_rows(hits(f))
    return rows.select(
        "change_id", "symbol_id", "change_kinds", "total_lines", F.size("changed_lines").alias("shown"), F.col("changed_lines")[0].alias("first"),
        F.element_at("changed_lines", -1).alias("last_shown"), "lines_truncated",
    )


@query("unresolved_changes", "change_id s, path s, status s, reason s", f"""
WITH {HITS}, spans AS (SELECT * FROM f_spans), docs AS (SELECT DISTINCT path FROM f_diags WHERE path IS NOT NULL)
SELECT_RESULT
SELECT f.change_id, f.path, status, CASE WHEN status = 'deleted' OR NOT EXISTS (SELECT 1 FROM f_hunks h WHERE h.change_id = f.change_id AND h.path = f.path AND new_count > 0) THEN 'deleted-or-not-in-current-workspace'
  WHEN f.path NOT IN (SELECT path FROM docs) THEN 'source-file-not-in-current-workspace' ELSE 'no-source-symbol-overlaps-diff-hunk' END AS reason
FROM f_files f WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.change_id = f.change_id AND x.path = f.path)""")
def _(f):
    return spans.unresolved_changes(f.f_files, f.f_hunks, f.f_diags.filter("path IS NOT NULL"), hits(f))


@query("diagnostics_in_span", "target_id s, event_id i", """
SELECT DISTINCT concat('t:', s.symbol_id) AS target_id, event_id FROM f_spans s JOIN f_diags d ON d.path = s.path AND d.line <= s.end_line AND coalesce(d.end_line, d.line) >= s.line""")
def _(f):
    targets = f.sql("SELECT concat('t:', symbol_id) AS target_id, symbol_id FROM f_spans")
    return spans.diagnostics_in_span(targets, f.f_spans, f.f_diags)


AT = """
asked AS (SELECT concat('p', CAST(event_id AS VARCHAR)) AS target_id, path, line AS at_line, CASE WHEN event_type = 'login' OR event_type = 'signup' THEN concat('CS', CAST(CAST(floor(value * 10) AS INT) + 1 AS VARCHAR)) END AS diagnostic_id FROM f_points),
located AS (SELECT target_id, d.* FROM asked a JOIN f_diags d ON d.id = a.diagnostic_id WHERE diagnostic_id IS NOT NULL
  UNION ALL SELECT target_id, d.* FROM asked a JOIN f_diags d ON d.path = a.path AND a.at_line BETWEEN d.line AND coalesce(d.end_line, d.line) WHERE diagnostic_id IS NULL)"""


def _asked(f):
    return f.sql(
        "SELECT concat('p', CAST(event_id AS STRING)) AS target_id, path, line AS at_line, CASE WHEN event_type = 'login' OR event_type = 'signup' "
        "THEN concat('CS', CAST(CAST(floor(value * 10) AS INT) + 1 AS STRING)) END AS diagnostic_id FROM f_points"
    )


@query("diagnostics_at", "target_id s, event_id i, position i, total i, truncated b", f"""
WITH {AT}, placed AS (SELECT target_id, event_id, row_number() OVER (PARTITION BY target_id ORDER BY path NULLS FIRST, line NULLS FIRST, column_no, project, id, severity, message, end_line NULLS FIRST, end_column, event_id) AS position, count(*) OVER (PARTITION BY target_id) AS total FROM located)
SELECT_RESULT
SELECT target_id, event_id, position, total, total > 5 AS truncated FROM placed WHERE position <= 5""")
def _(f):
    return spans.diagnostics_at(_asked(f), f.f_diags, 5)


@query("representative_diagnostic", "target_id s, path s, line i, id s, severity s, message s", f"""
WITH {AT}, placed AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY path, line, column_no, project, id, severity, message) AS rn FROM located WHERE path IS NOT NULL)
SELECT_RESULT
SELECT target_id, path, line, id, severity, message FROM placed WHERE rn = 1""")
def _(f):
    return spans.representative(_asked(f), f.f_diags)


@query("diagnostics_scope", "change_id s, path s, reasons a", """
SELECT change_id, path, list_sort(list_distinct(list(r))) AS reasons FROM (SELECT change_id, path, 'changed-file' AS r FROM f_files
  UNION SELECT concat('c-', event_type), path, 'affected-file' FROM f_points) x GROUP BY change_id, path""")
def _(f):
    return usage.diagnostics_scope(f.f_files, f.sql("SELECT concat('c-', event_type) AS change_id, path FROM f_points"))


@query("diagnostics_in_scope", "event_id i, reason s", """
SELECT event_id, CASE WHEN path IS NULL THEN 'project-diagnostic-in-touched-project' ELSE 'diagnostic-in-diff-scope' END AS reason FROM f_diags
WHERE path IN (SELECT path FROM f_files) OR (path IS NULL AND project IN (SELECT project FROM f_diags WHERE path IN (SELECT path FROM f_files)))""")
def _(f):
    return spans.diagnostics_in_scope(f.f_diags, f.f_files, f.f_diags.select("project", "path"))


@query("diagnostics_for_context", "target_id s, event_id i", """
SELECT DISTINCT target_id, event_id FROM (SELECT concat('u', CAST(user_id AS VARCHAR)) AS target_id, path FROM f_points WHERE event_type = 'error' UNION SELECT concat('u', CAST(user_id AS VARCHAR)), path FROM f_points WHERE event_type = 'purchase') s
JOIN f_diags d ON d.path = s.path""")
def _(f):
    part = lambda t: f.sql(f"SELECT concat('u', CAST(user_id AS STRING)) AS target_id, path FROM f_points WHERE event_type = '{t}'")
    return spans.diagnostics_for_context(f.f_diags, part("error"), part("purchase"))


@query("filter_diagnostics", "event_id i, severity s, id s", """
SELECT event_id, severity, id FROM f_diags WHERE severity IN ('Error', 'Warning') AND id IN ('CS1', 'CS2', 'CS7', 'CS40')""")
def _(f):
    return filters.filter_diagnostics(f.f_diags, ["Error", "Warning"], ["CS1", "CS2", "CS7", "CS40"])


RANGES = """
asked AS (SELECT concat('e', CAST(event_id AS VARCHAR)) AS target_id, path, line, CASE WHEN event_id % 3 = 0 THEN NULL ELSE column_no END AS start_column,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 17 = 0 THEN NULL ELSE column_no + event_id % 9 END AS end_column FROM f_points),
lengths AS (SELECT path, line, max(column_no) + 5 AS length FROM f_points WHERE event_type <> 'error' GROUP BY path, line),
ids AS (SELECT path, line, concat(event_type, CAST(user_id % 5 AS VARCHAR)) AS symbol_id, column_no, column_no + 4 AS end_column FROM f_points)"""


def _range_inputs(f):
    asked = f.sql(
        "SELECT concat('e', CAST(event_id AS STRING)) AS target_id, path, line, CASE WHEN event_id % 3 = 0 THEN NULL ELSE column_no END AS start_column, "
        "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 17 = 0 THEN NULL ELSE column_no + event_id % 9 END AS end_column FROM f_points"
    )
    lengths = f.sql("SELECT path, line, max(column_no) + 5 AS length FROM f_points WHERE event_type <> 'error' GROUP BY path, line")
    ids = f.sql("SELECT path, line, concat(event_type, CAST(user_id % 5 AS STRING)) AS symbol_id, column_no, column_no + 4 AS end_column FROM f_points")
    return asked, ids, lengths


@query("symbols_in_range", "target_id s, symbol_id s, status s", f"""
WITH {RANGES}, sized AS (SELECT a.target_id, a.path, a.line, length, CASE WHEN start_column IS NULL AND end_column IS NULL THEN 1 ELSE start_column END AS s,
  CASE WHEN start_column IS NULL AND end_column IS NULL THEN length + 1 ELSE end_column END AS e FROM asked a LEFT JOIN lengths l ON l.path = a.path AND l.line = a.line),
marked AS (SELECT *, coalesce(length IS NOT NULL AND s >= 1 AND e >= s AND e <= length + 1, false) AS good FROM sized)
SELECT_RESULT
SELECT DISTINCT target_id, symbol_id, 'ok' AS status FROM marked m JOIN ids i ON i.path = m.path AND i.line = m.line AND i.column_no < m.e AND m.s < i.end_column WHERE good
UNION ALL SELECT target_id, NULL, 'invalid-range' FROM marked WHERE NOT good""")
def _(f):
    return spans.symbols_in_range(*_range_inputs(f))


@query("scope_stack", "path s, at_line i, symbol_id s, depth i", """
SELECT p.path, p.line AS at_line, s.symbol_id, row_number() OVER (PARTITION BY p.path, p.line ORDER BY s.line, s.end_line DESC, s.symbol_id) AS depth
FROM (SELECT DISTINCT path, line FROM f_points) p JOIN f_spans s ON s.path = p.path AND p.line BETWEEN s.line AND s.end_line""")
def _(f):
    points = f.f_points.select("path", F.col("line").alias("at_line"))
    return spans.scope_stack(points, f.f_spans, payload=("symbol_id",))


@query("symbol_at_position", "target_id s, hit_symbol s, status s, def_path s, def_line i", """
WITH points AS (SELECT concat('e', CAST(event_id AS VARCHAR)) AS target_id, path, line, CAST(column_no + event_id % 3 AS INT) AS column_no FROM f_points),
ids AS (SELECT DISTINCT path, line, concat(event_type, CAST(user_id % 5 AS VARCHAR)) AS hit_symbol, column_no, column_no + 1 AS last FROM f_points),
defs AS (SELECT concat(event_type, CAST(user_id % 5 AS VARCHAR)) AS hit_symbol, path AS def_path, min(line) AS def_line FROM f_points GROUP BY ALL),
under AS (SELECT p.path, p.line, p.column_no, (min(ROW(last - i.column_no, hit_symbol)))[2] AS hit_symbol FROM (SELECT DISTINCT path, line, column_no FROM points) p JOIN ids i ON i.path = p.path AND i.line = p.line AND p.column_no BETWEEN i.column_no AND i.last GROUP BY ALL),
joined AS (SELECT p.target_id, u.hit_symbol, d.def_path, d.def_line, row_number() OVER (PARTITION BY p.target_id ORDER BY def_path <> p.path NULLS FIRST, def_path, def_line) AS rn
  FROM points p LEFT JOIN under u ON u.path = p.path AND u.line = p.line AND u.column_no = p.column_no LEFT JOIN defs d ON d.hit_symbol = u.hit_symbol)
SELECT_RESULT
SELECT target_id, hit_symbol, CASE WHEN hit_symbol IS NULL THEN 'not-found' ELSE 'ok' END AS status, def_path, def_line FROM joined WHERE rn = 1""")
def _(f):
    points = f.sql("SELECT concat('e', CAST(event_id AS STRING)) AS target_id, path, line, CAST(column_no + event_id % 3 AS INT) AS column_no FROM f_points")
    ids = f.sql(
        "SELECT path, line, concat(event_type, CAST(user_id % 5 AS STRING)) AS symbol_id, column_no, column_no + 2 AS end_column FROM f_points"
    )
    defs = f.sql(
        "SELECT concat(event_type, CAST(user_id % 5 AS STRING)) AS symbol_id, path, min(line) AS line, 1 AS column_no, min(line) AS end_line, 1 AS end_column "
        "FROM f_points GROUP BY 1, path"
    )
    return spans.symbol_at(points, ids, defs)


@query("number_rows", "user_id i, event_id i, place i", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events")
def _(f):
    return core.number_rows(f.events.select("user_id", "event_id"), ["user_id"], "event_id")
