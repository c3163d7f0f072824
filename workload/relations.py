"""References, usage counts, call and type relations, chains, related files."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspan.operators import chains, core, filters, graph, impact, usage
from factspan.plans import lookup as plans

from .registry import query

LOCS = "path, line, column_no, end_line, end_column"
LOCS_AS = "path, line, column_no AS \"column\", end_line, end_column"
USED = f"""
used AS (
  SELECT concat('t:', target_symbol_id) AS target_id, target_symbol_id AS symbol_id, path, line, column_no, end_line, end_column,
    arg_min(usage_kind, ROW(usage_kind, project)) AS usage_kind, arg_min(project, ROW(usage_kind, project)) AS project
  FROM f_refs GROUP BY ALL)"""
KIND_ORDER = "CASE usage_kind WHEN 'read' THEN 0 WHEN 'write' THEN 1 WHEN 'invoke' THEN 2 ELSE 100 END"


def asked(f):
    return f.sql("SELECT concat('t:', symbol_id) AS target_id, symbol_id FROM f_asked")


def used(f):
    refs = usage.references_of(asked(f), f.f_refs)
    return refs.withColumn("kind_of_project", F.when(F.col("project").contains("Tests"), "test").otherwise("production"))


@query("references_of_targets", "target_id s, usage_kind s, project s, path s, line i, column i, end_column i", f"""
WITH {USED}
SELECT_RESULT
SELECT target_id, usage_kind, project, path, line, column_no AS "column", end_column FROM used""")
def _(f):
    return used(f)


@query("usage_counts", "target_id s, usage_kind s, reference_count i, kind_order i", f"""
WITH {USED}
SELECT_RESULT
SELECT target_id, usage_kind, count(*) AS reference_count, {KIND_ORDER} AS kind_order FROM used GROUP BY ALL""")
def _(f):
    return usage.usage_counts(used(f))


@query("grouped_usage", "target_id s, group_by s, key s, reference_count i, read_count i, group_order i, path s, line i, column i", f"""
WITH {USED}, keyed AS (
  SELECT *, 'file' AS group_by, path AS key, 0 AS group_order FROM used UNION ALL SELECT *, 'project', project, 1 FROM used
  UNION ALL SELECT *, 'usage-kind', usage_kind, 3 FROM used
  UNION ALL SELECT *, 'test-vs-production', CASE WHEN contains(project, 'Tests') THEN 'test' ELSE 'production' END, 4 FROM used)
SELECT_RESULT
SELECT target_id, group_by, key, count(*) AS reference_count, count(*) FILTER (usage_kind = 'read') AS read_count, group_order, (min(ROW({LOCS})))[1] AS path,
 (min(ROW({LOCS})))[2] AS line, (min(ROW({LOCS})))[3] AS "column" FROM keyed GROUP BY target_id, group_by, key, group_order""")
def _(f):
    dims = {"file": "path", "project": "project", "usage-kind": "usage_kind", "test-vs-production": "kind_of_project"}
    groups = usage.grouped_usage(used(f), dims)
    return groups.withColumn("read_count", F.coalesce(F.try_element_at("usage_kind_counts", F.lit("read")), F.lit(0)))


@query("files_by_references", "target_id s, path s, reference_count i, kinds a, first_line i, position i, total i, truncated b", f"""
WITH {USED}, per_kind AS (SELECT target_id, path, usage_kind, {KIND_ORDER} AS o, count(*) AS n, min(line) AS first_line FROM used GROUP BY ALL),
files AS (SELECT target_id, path, sum(n) AS reference_count, list(concat(usage_kind, ':', CAST(n AS VARCHAR)) ORDER BY o) AS kinds, min(first_line) AS first_line FROM per_kind GROUP BY target_id, path),
placed AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY reference_count DESC, path) AS position, count(*) OVER (PARTITION BY target_id) AS total FROM files)
SELECT_RESULT
SELECT target_id, path, reference_count, kinds, first_line, position, total, total > 10 AS truncated FROM placed WHERE position <= 10""")
def _(f):
    files = usage.files_by_references(used(f), 10)
    return files.withColumn("kinds", F.transform(F.map_entries("usage_kind_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))


@query("filter_locations", "target_symbol_id s, path s, line i, usage_kind s", """
SELECT target_symbol_id, path, line, usage_kind FROM f_refs r WHERE (contains(path, '/A/') OR contains(path, 'o17')) AND usage_kind IN ('read', 'invoke')
AND EXISTS (SELECT 1 FROM orders o WHERE concat('src/', substr(o_orderstatus, 1, 1), '/o', CAST(o_orderkey % 500 AS VARCHAR), '.cs') = replace(r.path, '/A/', '/F/'))""")
def _(f):
    docs = f.sql(
        "SELECT DISTINCT concat('src/', CASE WHEN o_orderstatus = 'F' THEN s ELSE o_orderstatus END, '/o', CAST(o_orderkey % 500 AS STRING), '.cs') AS path "
        "FROM orders LATERAL VIEW explode(array('F', 'A')) x AS s"
    )
    return filters.filter_locations(f.f_refs, ["\\A\\", "o17"], ["read", "invoke"], docs)


@query("merge_locations", "caller_id s, callee_id s, path s, line i, column i", """
SELECT DISTINCT caller_id, callee_id, path, line, column_no AS "column" FROM f_calls""")
def _(f):
    return core.merge_locations(f.f_calls, ["caller_id", "callee_id"])


@query("location_heads", "target_symbol_id s, location_count i, first_path s, first_line i, shown i", f"""
WITH d AS (SELECT DISTINCT target_symbol_id, {LOCS} FROM f_refs)
SELECT_RESULT
SELECT target_symbol_id, count(*) AS location_count, (min(ROW({LOCS})))[1] AS first_path, (min(ROW({LOCS})))[2] AS first_line, least(count(*), 5) AS shown FROM d GROUP BY target_symbol_id""")
def _(f):
    return core.location_heads(f.f_refs, ["target_symbol_id"]).select(
        "target_symbol_id", "location_count", F.col("first_location.path").alias("first_path"),
        F.col("first_location.line").alias("first_line"), F.size("first_locations").alias("shown"),
    )


@query("merge_partials", "symbol_id s, part_count i, is_partial b, modifiers a, path s, line i", f"""
SELECT name AS symbol_id, count(*) AS part_count, count(*) > 1 AS is_partial, list_sort(list_distinct(list(accessibility))) AS modifiers,
 (min(ROW({LOCS})))[1] AS path, (min(ROW({LOCS})))[2] AS line FROM f_decls GROUP BY name""")
def _(f):
    return usage.merge_partials(f.f_decls.withColumn("symbol_id", F.col("name")).withColumn("modifiers", F.array("accessibility")))


CLOSURES = """
up AS (SELECT child_id AS seed, parent_id AS node, 1 AS depth, edge_kind FROM f_types
  UNION ALL SELECT u.seed, t.parent_id, depth + 1, t.edge_kind FROM up u JOIN f_types t ON t.child_id = u.node)"""


@query("implementations_of", "target_id s, symbol_id s, depth i", f"""
WITH RECURSIVE {CLOSURES}
SELECT_RESULT
SELECT DISTINCT concat('t', substr(node, 2)) AS target_id, seed AS symbol_id, depth FROM up WHERE node <> seed""")
def _(f):
    return graph.implementations_of(f.f_asked, f.f_types)


def _walk(kind: str, name: str, limit: str = "") -> str:
    cond = f"edge_kind = '{kind}'" if "," not in kind else f"edge_kind IN ({kind})"
    return f"""{name} AS (SELECT child_id AS low, parent_id AS high, 1 AS depth FROM f_types WHERE {cond}
  UNION ALL SELECT w.low, t.parent_id, depth + 1 FROM {name} w JOIN f_types t ON t.child_id = w.high AND t.{cond})"""


@query("type_hierarchy", "target_id s, relation s, symbol_id s, depth i", f"""
WITH RECURSIVE {_walk("base", "b")}, {_walk("override", "o")}, {_walk("implements", "m")}, {_walk("'base','interface'", "x")}
SELECT_RESULT
SELECT concat('t', substr(low, 2)) AS target_id, 'base-type' AS relation, high AS symbol_id, min(depth) AS depth FROM b WHERE low <> high GROUP BY low, high
UNION ALL SELECT concat('t', substr(child_id, 2)), 'interface', parent_id, 1 FROM f_types WHERE edge_kind = 'interface' AND child_id <> parent_id
UNION ALL SELECT concat('t', substr(high, 2)), 'derived-type', low, min(depth) FROM b WHERE low <> high GROUP BY low, high
UNION ALL SELECT concat('t', substr(high, 2)), 'implementing-type', low, min(depth) FROM x WHERE low <> high AND high IN (SELECT parent_id FROM f_types WHERE edge_kind = 'interface') GROUP BY low, high
UNION ALL SELECT concat('t', substr(low, 2)), 'base-member', high, min(depth) FROM o WHERE low <> high GROUP BY low, high
UNION ALL SELECT concat('t', substr(high, 2)), 'overriding-member', low, min(depth) FROM o WHERE low <> high GROUP BY low, high
UNION ALL SELECT concat('t', substr(high, 2)), 'implemented-member', low, min(depth) FROM m WHERE low <> high GROUP BY low, high""")
def _(f):
    return graph.type_hierarchy(f.f_asked, f.f_types)


RELATED = f"""{_walk("override", "o")}, {_walk("'override','implements'", "om")},
related AS (SELECT target_id, symbol_id AS node FROM f_asked UNION SELECT concat('t', substr(low, 2)), high FROM o
  UNION SELECT concat('t', substr(child_id, 2)), parent_id FROM f_types WHERE edge_kind = 'implements'
  UNION SELECT concat('t', substr(high, 2)), low FROM om)"""


@query("callers_of", "target_id s, caller_id s, path s, line i, column i", f"""
WITH RECURSIVE {RELATED}
SELECT_RESULT
SELECT DISTINCT target_id, caller_id, path, line, column_no AS "column" FROM related r JOIN f_calls c ON c.callee_id = r.node""")
def _(f):
    return graph.callers_of(f.f_asked, f.f_calls, f.f_types)


@query("calls_of", "target_id s, callee_id s, location_count i, path s, line i", f"""
SELECT a.target_id, callee_id, count(DISTINCT ROW({LOCS})) AS location_count, (min(ROW({LOCS})))[1] AS path, (min(ROW({LOCS})))[2] AS line
FROM f_asked a JOIN f_calls c ON c.caller_id = a.symbol_id WHERE callee_id IN (SELECT symbol_id FROM f_decls WHERE kind <> 'Property') GROUP BY a.target_id, callee_id""")
def _(f):
    return graph.call_groups(graph.calls_of(f.f_asked, f.f_calls, f.f_decls.filter("kind <> 'Property'")), "callee_id")


@query("closure_depths", "target_id s, node s, depth i", f"""
WITH RECURSIVE e AS (SELECT DISTINCT caller_id AS a, callee_id AS b FROM f_calls WHERE caller_id <> callee_id),
seeds AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS s FROM supplier),
r AS (SELECT s, s AS node, 0 AS depth FROM seeds UNION SELECT r.s, e.b, depth + 1 FROM r JOIN e ON e.a = r.node WHERE depth < 6)
SELECT_RESULT
SELECT s AS target_id, node, min(depth) AS depth FROM r WHERE node <> s GROUP BY s, node""")
def _(f):
    seeds = f.sql("SELECT concat('S', CAST(s_suppkey AS STRING)) AS target_id, concat('S', CAST(s_suppkey AS STRING)) AS node FROM supplier")
    return graph.closure(f.f_calls, seeds, "caller_id", "callee_id", max_depth=6)


CHAINS = """
e AS (SELECT DISTINCT callee_id AS a, caller_id AS b FROM f_calls),
c AS (SELECT target_id, [symbol_id] AS chain, symbol_id AS last, 1 AS n, false AS stop FROM f_asked
  UNION ALL SELECT target_id, list_append(chain, e.b), e.b, n + 1, list_contains(chain, e.b) FROM c JOIN e ON e.a = c.last WHERE NOT stop AND n <= 3),
done AS (SELECT *, CASE WHEN stop THEN 'cycle-detected' WHEN n > 3 THEN 'depth-limit' ELSE 'no-upstream-callers' END AS end_reason FROM c
  WHERE stop OR n > 3 OR last NOT IN (SELECT a FROM e)),
placed AS (SELECT done.*, path, line, column_no, row_number() OVER (PARTITION BY target_id ORDER BY n, path, line, column_no, chain) AS position
  FROM done LEFT JOIN f_decls d ON d.symbol_id = last)"""


@query("upstream_chains", "target_id s, chain a, end_reason s, position i, terminal_id s", f"""
WITH RECURSIVE {CHAINS}
SELECT_RESULT
SELECT target_id, chain, end_reason, position, last AS terminal_id FROM placed WHERE position <= 12""")
def _(f):
    places = f.f_decls.select("symbol_id", "path", "line", "column")
    return chains.upstream_chains(f.f_asked, f.f_calls, places, depth=3, limit=12)


@query("entrypoint_chains", "target_id s, chain a, end_reason s, entrypoint_kind s, position i", f"""
WITH RECURSIVE {CHAINS}, kept AS (SELECT p.* FROM placed p JOIN f_asked a ON a.target_id = p.target_id JOIN f_decls d ON d.symbol_id = a.symbol_id WHERE d.kind IN ('Method', 'Property') AND position <= 6),
eps AS (SELECT path, line, column_no, min(namespace) AS entrypoint_kind FROM f_decls WHERE accessibility = 'Public' GROUP BY ALL)
SELECT_RESULT
SELECT target_id, chain, CASE WHEN entrypoint_kind IS NOT NULL THEN 'framework-entrypoint' ELSE end_reason END AS end_reason, entrypoint_kind, position
FROM kept k LEFT JOIN eps x ON x.path = k.path AND x.line = k.line AND x.column_no = k.column_no""")
def _(f):
    eps = f.f_decls.filter("accessibility = 'Public'").withColumn("entrypoint_kind", F.col("namespace"))
    return plans.entrypoints(f.f_asked, f.f_decls, f.f_calls, eps, depth=3, limit=6)


EVIDENCE = f"""{RELATED}, {_walk("'base','interface','override','implements'", "y")}, {_walk("base", "b")}, {_walk("'base','interface'", "x")},
callable AS (SELECT a.* FROM f_asked a JOIN f_decls d ON d.symbol_id = a.symbol_id WHERE kind IN ('Method', 'Property')),
evidence AS (
  SELECT a.target_id, {LOCS}, 0 AS r, true AS direct FROM f_asked a JOIN f_decls d ON d.symbol_id = a.symbol_id
  UNION SELECT a.target_id, {LOCS}, 1, true FROM f_asked a JOIN f_refs r ON r.target_symbol_id = a.symbol_id
  UNION SELECT r.target_id, {LOCS}, 2, true FROM related r JOIN f_calls c ON c.callee_id = r.node WHERE r.target_id IN (SELECT target_id FROM callable)
  UNION SELECT a.target_id, d.path, d.line, d.column_no, d.end_line, d.end_column, 5, false FROM callable a JOIN f_calls c ON c.caller_id = a.symbol_id JOIN f_decls d ON d.symbol_id = c.callee_id
  UNION SELECT concat('t', substr(high, 2)), {LOCS}, 3, false FROM y JOIN f_decls d ON d.symbol_id = low WHERE low <> high
  UNION SELECT concat('t', substr(high, 2)), {LOCS}, 4, false FROM b JOIN f_decls d ON d.symbol_id = low WHERE low <> high
  UNION SELECT concat('t', substr(high, 2)), {LOCS}, 4, false FROM x JOIN f_decls d ON d.symbol_id = low WHERE low <> high AND high IN (SELECT parent_id FROM f_types WHERE edge_kind = 'interface')),
files AS (
  SELECT target_id, path, list_sort(list_distinct(list(r))) AS ranks, min(r) AS reason_rank, CASE WHEN bool_or(direct) THEN 'direct' ELSE 'indirect' END AS impact_level,
    count(DISTINCT ROW({LOCS})) AS location_count, (min(ROW({LOCS})))[2] AS line FROM evidence GROUP BY target_id, path),
placed AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY reason_rank, impact_level, path) AS position, count(*) OVER (PARTITION BY target_id) AS total FROM files)"""
REASONS = "['declares-selected-symbol','references-selected-symbol','caller-of-selected-member','implements-selected-symbol','hierarchy-related-symbol','callee-of-selected-member']"


@query("related_files", "target_id s, path s, reasons a, impact_level s, location_count i, line i, position i, total i, truncated b", f"""
WITH RECURSIVE {EVIDENCE}
SELECT_RESULT
SELECT target_id, path, list_transform(ranks, lambda i: {REASONS}[i + 1]) AS reasons, impact_level, location_count, line, position, total, total > 8 AS truncated FROM placed WHERE position <= 8""")
def _(f):
    return plans.related(f.f_asked, f.f_decls, f.f_refs, f.f_calls, f.f_types, impact_levels=True, limit=8)


@query("members_of_types", "target_id s, symbol_id s, container s", """
WITH outline AS (
  SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS symbol_id, concat('R.', CAST(n_regionkey AS VARCHAR), '.', n_name) AS container, concat('f', CAST(n_regionkey AS VARCHAR)) AS path, c_custkey AS line, 1 AS column_no
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
types AS (SELECT concat('n', CAST(n_nationkey AS VARCHAR)) AS target_id, concat('R.', CAST(n_regionkey AS VARCHAR), '.', n_name) AS fqn, concat('f', CAST(n_regionkey AS VARCHAR)) AS path, n_nationkey AS line FROM nation
  UNION ALL SELECT concat('r', CAST(r_regionkey AS VARCHAR)), concat('R.', CAST(r_regionkey AS VARCHAR)), concat('f', CAST(r_regionkey AS VARCHAR)), -1 FROM region)
SELECT_RESULT
SELECT target_id, o.symbol_id, container FROM types t JOIN outline o ON o.path = t.path AND (o.container = t.fqn OR starts_with(o.container, concat(t.fqn, '.'))) WHERE o.line <> t.line""")
def _(f):
    entries = f.sql(
        "SELECT concat('c', CAST(c_custkey AS STRING)) AS symbol_id, concat('R.', CAST(n_regionkey AS STRING), '.', n_name) AS container, "
        "concat('f', CAST(n_regionkey AS STRING)) AS path, c_custkey AS line, 1 AS column_no FROM customer JOIN nation ON n_nationkey = c_nationkey"
    )
    types = f.sql(
        "SELECT concat('n', CAST(n_nationkey AS STRING)) AS target_id, concat('R.', CAST(n_regionkey AS STRING), '.', n_name) AS fqn, "
        "concat('f', CAST(n_regionkey AS STRING)) AS path, n_nationkey AS line, 1 AS column_no FROM nation UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), "
        "concat('R.', CAST(r_regionkey AS STRING)), concat('f', CAST(r_regionkey AS STRING)), -1, 1 FROM region"
    )
    return impact.members_of(types, entries)


@query("outline_of_files", "path s, symbol_id s, candidate_id s, line i", """
SELECT d.path, symbol_id, concat('sym:v1:', substr(sha256(concat_ws(chr(10), 'v1', coalesce(doc_id, ''), coalesce(fqn, ''), kind, project, coalesce(target_framework, ''), d.path,
  CAST(d.line AS VARCHAR), CAST(column_no AS VARCHAR), CAST(end_line AS VARCHAR), CAST(end_column AS VARCHAR))), 1, 32)) AS candidate_id, d.line
FROM f_decls d WHERE d.path IN (SELECT concat('src/', p_type, '/f', CAST(p_size AS VARCHAR), '.cs') FROM part)""")
def _(f):
    files = f.sql("SELECT concat('src/', p_type, '/f', CAST(p_size AS STRING), '.cs') AS path FROM part")
    return impact.outline(files, f.f_decls)


@query("api_visible", "symbol_id s, accessibility s", f"""
WITH RECURSIVE {_walk("'base','interface','override','implements'", "y")}
SELECT_RESULT
SELECT symbol_id, accessibility FROM f_decls d WHERE accessibility IN ('Public', 'Protected')
AND NOT EXISTS (SELECT 1 FROM y JOIN f_decls h ON h.symbol_id = y.high WHERE y.low = d.symbol_id AND y.high <> y.low AND h.accessibility NOT IN ('Public', 'Protected'))""")
def _(f):
    return filters.api_visible(f.f_decls, f.f_types)


@query("set_operations", "part s, name s, line i", """
SELECT 'union' AS part, name, 0 AS line FROM (SELECT DISTINCT name FROM f_base UNION SELECT DISTINCT name FROM f_head) u
UNION ALL SELECT 'first', doc_id, column_no FROM f_base UNION ALL SELECT 'first', doc_id, column_no FROM f_head WHERE doc_id NOT IN (SELECT doc_id FROM f_base)
UNION ALL SELECT 'difference', doc_id, line FROM f_base WHERE doc_id NOT IN (SELECT doc_id FROM f_head)""")
def _(f):
    base, head = f.f_base, f.f_head
    union = core.union_distinct(base.select("name"), head.select("name")).select(F.lit("union").alias("part"), "name", F.lit(0).alias("line"))
    first = core.union_first_wins(base.select("doc_id", "column"), head.select("doc_id", "column"), ["doc_id"], ["column"])
    first = first.select(F.lit("first").alias("part"), F.col("doc_id").alias("name"), F.col("column").alias("line"))
    gone = core.difference(base, head, ["doc_id"]).select(F.lit("difference").alias("part"), F.col("doc_id").alias("name"), "line")
    return union.unionByName(first).unionByName(gone)


@query("dedupe_first", "path s, line i, symbol s, kind s", """
SELECT path, line, (min(ROW(usage_kind, target_symbol_id)))[2] AS symbol, (min(ROW(usage_kind, target_symbol_id)))[1] AS kind FROM f_refs GROUP BY path, line""")
def _(f):
    first = core.dedupe_first(f.f_refs, ["path", "line"], ["usage_kind", "target_symbol_id"])
    return first.select("path", "line", F.col("target_symbol_id").alias("symbol"), F.col("usage_kind").alias("kind"))


@query("bounded_section", "path s, position i, target_symbol_id s, total i, truncated b", f"""
SELECT path, position, target_symbol_id, total, total > 7 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, column_no, end_column, target_symbol_id, project, usage_kind) AS position, count(*) OVER (PARTITION BY path) AS total FROM f_refs) x WHERE position <= 7""")
def _(f):
    return core.bounded_section(f.f_refs, ["line", "column", "end_column", "target_symbol_id", "project", "usage_kind"], 7, ["path"])


@query("bounded_section_global", "position i, target_symbol_id s, path s, total i, truncated b", """
SELECT position, target_symbol_id, path, total, total > 50 AS truncated FROM (
  SELECT *, row_number() OVER (ORDER BY line DESC, column_no, path, end_column, target_symbol_id, project) AS position, count(*) OVER () AS total FROM f_refs) x WHERE position <= 50""")
def _(f):
    return core.bounded_section(f.f_refs, ["-line", "column", "path", "end_column", "target_symbol_id", "project"], 50)


@query("stable_order", "project s, path s, line i, symbol_id s", """
SELECT project, path, line, symbol_id FROM f_decls ORDER BY project, path, line, symbol_id""")
def _(f):
    return core.stable_order(f.f_decls.select("project", "path", "line", "symbol_id"), ["project", "path", "line", "symbol_id"])


LINE = "concat_ws('|', target_symbol_id, usage_kind, CAST(line AS VARCHAR), CAST(column_no AS VARCHAR))"


@query("fingerprints", "path s, row_count i, fingerprint s, form s", f"""
SELECT path, count(*) AS row_count, substr(sha256(string_agg({LINE}, chr(10) ORDER BY target_symbol_id, usage_kind, line, column_no)), 1, 16) AS fingerprint, 'plain' AS form
FROM f_refs GROUP BY path""")
def _(f):
    return core.fingerprint(f.f_refs, ["path"], ["target_symbol_id", "usage_kind", "line", "column"], 16)


def _merkle_level(source: str) -> str:
    return f"""SELECT usage_kind, place // 64 AS place, CASE WHEN count(*) = 1 THEN min(item) ELSE sha256(string_agg(item, chr(10) ORDER BY place)) END AS item
  FROM {source} GROUP BY usage_kind, place // 64"""


@query("merkle_fingerprints", "usage_kind s, row_count i, fingerprint s, form s", f"""
WITH leaves AS (
  SELECT usage_kind, sha256({LINE}) AS item, row_number() OVER (PARTITION BY usage_kind ORDER BY path, line, column_no, end_line, end_column, {LINE}) - 1 AS place FROM f_refs),
m1 AS ({_merkle_level('leaves')}), m2 AS ({_merkle_level('m1')}), m3 AS ({_merkle_level('m2')}), m4 AS ({_merkle_level('m3')}),
counts AS (SELECT usage_kind, count(*) AS row_count FROM f_refs GROUP BY usage_kind)
SELECT_RESULT
SELECT usage_kind, row_count, sha256(concat(usage_kind, chr(10), item)) AS fingerprint, 'merkle' AS form FROM m4 JOIN counts USING (usage_kind)""")
def _(f):
    order = ["path", "line", "column", "end_line", "end_column"]
    return core.fingerprint(f.f_refs, ["usage_kind"], ["target_symbol_id", "usage_kind", "line", "column"], order=order, head=["usage_kind"], plain_bytes=0, run=64)


SCOPE_TARGETS = "SELECT n_name AS target_id, 'r' AS repo, n_name AS project, min(c_name) AS path FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"
SCOPE_EDGES = (
    "SELECT 'r' AS repo, a.n_name AS from_project, b.n_name AS to_project FROM nation a JOIN nation b ON b.n_nationkey = CAST((a.n_nationkey - a.n_nationkey % 2) / 2 AS BIGINT) WHERE a.n_nationkey > 0"
)
SCOPE_DOCS = "SELECT 'r' AS repo, n_name AS project, c_name AS path FROM customer JOIN nation ON n_nationkey = c_nationkey"


@query("search_scope", "scope s, target_id s, project s, path s, is_own b", f"""
WITH RECURSIVE t AS ({SCOPE_TARGETS}), e AS ({SCOPE_EDGES}), d AS ({SCOPE_DOCS}),
up AS (SELECT from_project AS low, to_project AS high FROM e UNION SELECT up.low, e.to_project FROM up JOIN e ON e.from_project = up.high),
s AS (SELECT 'file' AS scope, target_id, d.* FROM t JOIN d ON d.project = t.project AND d.path = t.path UNION ALL SELECT 'project', target_id, d.* FROM t JOIN d ON d.project = t.project
  UNION ALL SELECT 'dependent-projects', target_id, d.* FROM t JOIN d ON d.project = t.project OR d.project IN (SELECT low FROM up WHERE up.high = t.project))
SELECT_RESULT
SELECT scope, s.target_id, s.project, s.path, s.project = t.project AND s.path = t.path AS is_own FROM s JOIN t ON t.target_id = s.target_id""")
def _(f):
    targets, edges, docs = f.sql(SCOPE_TARGETS), f.sql(SCOPE_EDGES), f.sql(SCOPE_DOCS)
    parts = [
        graph.search_scope(targets, edges, docs, scope).withColumn("scope", F.lit(scope)) for scope in ("file", "project", "dependent-projects")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
