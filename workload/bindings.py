"""Fact views over the given tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

# Declarations: parts. Names repeat (they are p_name), differ in case, or are unique.
VIEWS["f_decls"] = """
  SELECT concat('S', CAST(p_partkey AS VARCHAR(20))) AS symbol_id,
         CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('M:', p_brand, '.', CAST(p_partkey AS VARCHAR(20))) END AS doc_id,
         CASE WHEN p_partkey % 5 = 0 THEN upper(p_name)
              WHEN p_partkey % 5 = 1 THEN concat(p_name, '_', CAST(p_partkey AS VARCHAR(20)))
              WHEN p_partkey % 50 = 2 THEN replace(p_name, ' ', '')
              ELSE p_name END AS name,
         CASE p_partkey % 3 WHEN 0 THEN 'NamedType' WHEN 1 THEN 'Method' ELSE 'Property' END AS kind,
         replace(p_brand, '#', '.') AS container,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(replace(p_brand, '#', '.'), '.', p_name) END AS fqn,
         p_type AS namespace,
         CASE p_partkey % 4 WHEN 0 THEN 'Public' WHEN 1 THEN 'Internal' WHEN 2 THEN 'Protected' ELSE 'Private' END AS accessibility,
         concat(p_name, '(', p_type, ')') AS signature,
         concat(CASE WHEN p_partkey % 17 < 4 THEN 'App.Tests' ELSE 'App' END, CAST(p_partkey % 17 AS VARCHAR(20))) AS project,
         CASE p_partkey % 17 % 3 WHEN 0 THEN 'net8.0' WHEN 1 THEN 'net6.0' ELSE NULL END AS target_framework,
         CASE WHEN p_partkey % 29 = 0 THEN concat('src/obj/', p_type, '/f', CAST(p_partkey % 97 AS VARCHAR(20)), '.cs')
              WHEN p_partkey % 31 = 0 THEN concat('src/', p_type, '/f', CAST(p_partkey % 97 AS VARCHAR(20)), '.g.cs')
              ELSE concat('src/', p_type, '/f', CAST(p_partkey % 97 AS VARCHAR(20)), '.cs') END AS path,
         CAST(p_size AS INT) AS line, CAST(p_partkey % 40 + 1 AS INT) AS column_no,
         CAST(p_size + p_partkey % 7 * 3 AS INT) AS end_line, CAST(p_partkey % 40 + 9 AS INT) AS end_column
  FROM part
"""

# Questions: whole part names, their words, upper-case forms, unspaced forms, unknown names.
VIEWS["f_targets"] = """
  SELECT concat(match, CASE WHEN case_sensitive THEN '!' ELSE '' END, ':', query) AS target_id, query, match, case_sensitive FROM (
    SELECT DISTINCT p_name AS query, 'smart' AS match, false AS case_sensitive FROM part
    UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'contains', false FROM part
    UNION SELECT DISTINCT concat(split_part(p_name, ' ', 2), '_'), 'smart', true FROM part
    UNION SELECT DISTINCT upper(p_name), 'exact', true FROM part
    UNION SELECT DISTINCT concat(p_name, '_1'), 'exact', false FROM part
    UNION SELECT DISTINCT concat(replace(p_name, ' ', '-'), '!'), 'smart', false FROM part
    UNION SELECT DISTINCT concat(p_name, '_', CAST(p_partkey AS VARCHAR(20))), 'exact', true FROM part
    UNION SELECT DISTINCT concat('no ', p_brand), 'smart', false FROM part
  ) q
"""

# References: line items.
VIEWS["f_refs"] = """
  SELECT concat('S', CAST(l_partkey AS VARCHAR(20))) AS target_symbol_id,
         CASE l_linenumber % 4 WHEN 0 THEN 'invoke' WHEN 1 THEN 'read' WHEN 2 THEN 'write' ELSE 'other' END AS usage_kind,
         concat(CASE WHEN l_suppkey % 7 < 2 THEN 'App.Tests' ELSE 'App' END, CAST(l_suppkey % 7 AS VARCHAR(20))) AS project,
         CASE WHEN l_suppkey % 7 < 2 THEN 'test' ELSE 'production' END AS project_kind,
         concat('src/', l_returnflag, '/o', CAST(l_orderkey % 500 AS VARCHAR(20)), '.cs') AS path,
         CAST(l_linenumber * 10 + l_suppkey % 10 AS INT) AS line, CAST(l_orderkey % 60 + 1 AS INT) AS column_no,
         CAST(l_linenumber * 10 + l_suppkey % 10 AS INT) AS end_line, CAST(l_orderkey % 60 + 1 + l_quantity AS INT) AS end_column
  FROM lineitem
"""

# Call and type edges: two sparse functions of the part key; the first has cycles, the second is a forest.
VIEWS["f_calls"] = """
  SELECT concat('S', CAST(a AS VARCHAR(20))) AS caller_id, concat('S', CAST(b AS VARCHAR(20))) AS callee_id,
         concat('src/f', CAST(a % 97 AS VARCHAR(20)), '.cs') AS path, CAST(a % 50 + 1 AS INT) AS line, CAST(b % 40 + 1 AS INT) AS column_no,
         CAST(a % 50 + 1 AS INT) AS end_line, CAST(b % 40 + 5 AS INT) AS end_column
  FROM (
    SELECT p_partkey AS a, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS b FROM part
    UNION ALL
    SELECT p_partkey AS a, CAST((p_partkey - p_partkey % 3) / 3 AS BIGINT) AS b FROM part WHERE p_partkey > 0
  ) e
"""
VIEWS["f_types"] = """
  SELECT concat('S', CAST(p_partkey AS VARCHAR(20))) AS child_id,
         concat('S', CAST(CAST((p_partkey - p_partkey % 3) / 3 AS BIGINT) AS VARCHAR(20))) AS parent_id,
         CASE p_partkey % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'interface' WHEN 2 THEN 'override' ELSE 'implements' END AS edge_kind
  FROM part WHERE p_partkey > 0
"""

# One question per part.
VIEWS["f_asked"] = "SELECT concat('t', CAST(p_partkey AS VARCHAR(20))) AS target_id, concat('S', CAST(p_partkey AS VARCHAR(20))) AS symbol_id FROM part"

# Spans and points: events of a user and day; spans are the extents of whole days, quarters of a day and hours.
VIEWS["f_points"] = """
  SELECT event_id, concat('u', CAST(user_id AS VARCHAR(20)), '/', CAST(CAST(ts AS DATE) AS VARCHAR(20)), '.cs') AS path,
         CAST(hour(ts) * 60 + minute(ts) AS INT) AS line, CAST(second(ts) + 1 AS INT) AS column_no, event_type, value, user_id
  FROM events
"""
VIEWS["f_spans"] = """
  SELECT concat(path, '#', g, CAST(b AS VARCHAR(20))) AS symbol_id, path,
         CASE g WHEN 'd' THEN 'NamedType' WHEN 'q' THEN 'Method' ELSE 'Property' END AS kind,
         CAST(min(line) AS INT) AS line, CAST(max(line) AS INT) AS end_line
  FROM (
    SELECT path, line, 'd' AS g, 0 AS b FROM f_points
    UNION ALL SELECT path, line, 'q' AS g, CAST(floor(line / 360) AS INT) AS b FROM f_points
    UNION ALL SELECT path, line, 'h' AS g, CAST(floor(line / 60) AS INT) AS b FROM f_points
  ) x GROUP BY path, g, b
"""
VIEWS["f_diags"] = """
  SELECT concat('App', CAST(user_id % 7 AS VARCHAR(20))) AS project,
         CASE WHEN value < 5 THEN 'Error' WHEN value < 20 THEN 'Warning' ELSE 'Info' END AS severity,
         concat('CS', CAST(CAST(floor(value * 10) AS INT) AS VARCHAR(20))) AS id, event_type AS message,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE path END AS path,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE line END AS line, column_no,
         CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 4 = 0 THEN NULL ELSE CAST(line + event_id % 45 AS INT) END AS end_line,
         CAST(column_no + 3 AS INT) AS end_column, event_id
  FROM f_points
"""

# Changes: the events of each type, as new-side line ranges of a user's day.
VIEWS["f_hunks"] = """
  SELECT concat('c-', event_type) AS change_id, path, line AS new_start, CAST(event_id % 6 AS INT) AS new_count
  FROM f_points
"""
VIEWS["f_files"] = """
  SELECT change_id, path, CASE WHEN min(new_count) = 0 AND max(new_count) > 3 THEN 'deleted' ELSE 'modified' END AS status
  FROM f_hunks GROUP BY change_id, path
"""

# Uses between the spans: every event refers to, and calls, the day of another user; hours implement quarters.
VIEWS["f_span_refs"] = """
  SELECT concat('u', CAST((user_id * 3 + 1) % 150 AS VARCHAR(20)), '/', split_part(path, '/', 2), '#d0') AS target_symbol_id, 'read' AS usage_kind, 'App' AS project,
         path, line, column_no, line AS end_line, CAST(column_no + 4 AS INT) AS end_column
  FROM f_points
"""
VIEWS["f_span_calls"] = """
  SELECT concat(path, '#h', CAST(CAST(floor(line / 60) AS INT) AS VARCHAR(20))) AS caller_id, concat('u', CAST((user_id * 3 + 1) % 150 AS VARCHAR(20)), '/', split_part(path, '/', 2), '#d0') AS callee_id,
         path, line, column_no, line AS end_line, CAST(column_no + 4 AS INT) AS end_column
  FROM f_points
"""
VIEWS["f_span_types"] = """
  SELECT symbol_id AS child_id, concat(path, '#q', CAST(CAST(floor(line / 360) AS INT) AS VARCHAR(20))) AS parent_id, 'implements' AS edge_kind FROM f_spans WHERE kind = 'Property'
"""
VIEWS["f_span_decls"] = """
  SELECT symbol_id, path, kind, symbol_id AS name, path AS container, symbol_id AS fqn, line, 1 AS column_no, end_line, 1 AS end_column,
         CASE kind WHEN 'NamedType' THEN 'Public' WHEN 'Method' THEN 'Internal' ELSE 'Protected' END AS accessibility, symbol_id AS doc_id, 'App' AS project
  FROM f_spans
"""

# API snapshots: orders; the head has some gone, some new, some with another id and some with changed facets.
VIEWS["f_base"] = """
  SELECT concat('M:', CAST(o_custkey AS VARCHAR(20)), '.', o_orderpriority, '(', CAST(o_orderkey AS VARCHAR(20)), ')') AS doc_id,
         CASE WHEN o_orderkey % 23 = 0 THEN 'NamedType' WHEN o_orderkey % 19 = 0 THEN 'EnumMember' ELSE 'Method' END AS kind,
         concat('C', CAST(o_custkey AS VARCHAR(20))) AS container, o_orderpriority AS name, o_orderstatus AS signature,
         CASE WHEN o_orderkey % 2 = 0 THEN 'abstract' ELSE 'public' END AS modifier,
         CAST(o_orderkey % 3 AS INT) AS param_count, o_orderstatus AS facet, CAST(o_orderkey % 5 AS INT) AS attribute_count,
         concat('src/', CAST(o_custkey % 50 AS VARCHAR(20)), '.cs') AS path, CAST(o_orderkey AS INT) AS line, 1 AS column_no
  FROM orders WHERE o_orderkey % 10 <> 0
"""
VIEWS["f_head"] = """
  SELECT concat('M:', CAST(o_custkey AS VARCHAR(20)), '.', o_orderpriority, '(', CAST(k AS VARCHAR(20)), ')') AS doc_id,
         CASE WHEN o_orderkey % 23 = 0 THEN 'NamedType' WHEN o_orderkey % 19 = 0 THEN 'EnumMember' ELSE 'Method' END AS kind,
         concat('C', CAST(o_custkey AS VARCHAR(20))) AS container, o_orderpriority AS name,
         CASE WHEN o_orderkey % 23 = 0 AND o_orderkey % 2 = 0 THEN concat(o_orderstatus, ' interface') WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS signature,
         CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 9 <> 0 THEN 'abstract' ELSE 'public' END AS modifier,
         CAST(o_orderkey % 3 AS INT) AS param_count, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS facet,
         CAST((o_orderkey + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END) % 5 AS INT) AS attribute_count,
         concat('src/', CAST(o_custkey % 50 AS VARCHAR(20)), '.cs') AS path, CAST(o_orderkey AS INT) AS line, 2 AS column_no
  FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS k FROM orders) o
  WHERE o_orderkey % 10 <> 1
"""

# Registrations and constructor parameters: line items and suppliers of parts.
VIEWS["f_regs"] = """
  SELECT DISTINCT concat('App', CAST(l_suppkey % 5 AS VARCHAR(20))) AS project,
         CASE WHEN l_linestatus = 'O' AND l_partkey % 4 = 0 THEN 'AddSingleton' WHEN l_linestatus = 'O' THEN 'AddScoped'
              WHEN l_partkey % 9 = 0 THEN 'AddHostedService' WHEN l_partkey % 10 = 1 THEN 'Configure' WHEN l_partkey % 13 = 0 THEN 'TryAddTransient'
              WHEN l_partkey % 21 = 2 THEN 'UseThing' ELSE 'AddTransient' END AS method_name,
         concat('T', CAST(l_partkey % 700 AS VARCHAR(20))) AS first_type,
         CASE WHEN l_partkey % 3 = 0 THEN concat('T', CAST(l_partkey AS VARCHAR(20))) ELSE NULL END AS second_type,
         concat('src/s', CAST(l_suppkey AS VARCHAR(20)), '.cs') AS path, CAST(l_partkey AS INT) AS line
  FROM lineitem
"""
VIEWS["f_ctors"] = """
  SELECT DISTINCT concat('T', CAST(l_partkey AS VARCHAR(20))) AS type_id, CAST(l_linenumber AS INT) AS ctor_ordinal,
         CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN 'Public' ELSE 'Internal' END AS ctor_access, CAST(l_linenumber * 10 AS INT) AS ctor_line,
         (l_partkey + l_linenumber) % 31 = 0 AS is_marked,
         concat('p', CAST(l_suppkey % 4 AS VARCHAR(20))) AS name,
         CASE WHEN l_suppkey % 5 = 0 THEN 'Microsoft.Extensions.Logging.ILogger' ELSE concat('T', CAST((l_partkey * 3 + l_suppkey) % 900 AS VARCHAR(20))) END AS type_fqn,
         CAST(l_suppkey % 4 AS INT) AS ordinal
  FROM lineitem
"""
# Tables of text lines.
VIEWS["f_docs"] = """
  SELECT concat('d', CAST(doc_id AS VARCHAR(20))) AS doc_key, lang AS repo, source AS project,
         concat('/work/', lang, '/', source, CASE WHEN doc_id % 7 = 0 THEN '/obj' ELSE '' END, '/doc', CAST(doc_id % 400 AS VARCHAR(20)),
                CASE doc_id % 6 WHEN 0 THEN '.g.cs' WHEN 1 THEN '.Designer.vb' WHEN 2 THEN '.txt' ELSE '.cs' END) AS path,
         text, n_chars, doc_id
  FROM documents
"""
