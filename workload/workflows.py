"""Composite questions: where used, about, changes, reviews, context packs, preflights, lists and overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspan.plans import changes, context, lookup, repositories

from .lookup import CHOSEN, RANKED as RANKED_NAMES, targets
from .registry import query
from .relations import REASONS, _walk
from .reviews import FOUND, TESTS, async_findings, security_findings, tests
from .snapshots import COMPARE, sides
from .spans import AT, HITS

LOCS = "path, line, column_no, end_line, end_column"
CHANGED = f"""
{HITS.replace('FROM f_hunks WHERE', "FROM f_hunks WHERE (change_id, path) IN (SELECT change_id, path FROM f_files WHERE status <> 'deleted') AND")}"""


def changed(f):
    return changes.changed_symbols(f.f_files, f.f_hunks, f.f_diags.filter("path IS NOT NULL"), f.f_span_decls)


@query("changed_symbols", "change_id s, symbol_id s, kind s, accessibility s, total_lines i, change_kinds a", f"""
WITH {CHANGED}
SELECT_RESULT
SELECT h.change_id, h.symbol_id, kind, accessibility, count(DISTINCT changed_line) AS total_lines, [min(change_kind)] AS change_kinds FROM hits h JOIN f_span_decls d ON d.symbol_id = h.symbol_id GROUP BY ALL""")
def _(f):
    return changed(f)["symbols"]


IMPACT = f"""
{CHANGED}, changed_symbols AS (SELECT DISTINCT change_id, symbol_id FROM hits),
impl AS (SELECT parent_id AS s, child_id AS o FROM f_span_types),
related AS (SELECT DISTINCT symbol_id, symbol_id AS node FROM changed_symbols UNION SELECT parent_id, child_id FROM f_span_types UNION SELECT child_id, parent_id FROM f_span_types),
callers AS (SELECT DISTINCT r.symbol_id, c.* FROM related r JOIN f_span_calls c ON c.callee_id = r.node),
evidence AS (
  SELECT symbol_id, {LOCS}, 0 AS r FROM f_span_decls WHERE symbol_id IN (SELECT symbol_id FROM changed_symbols)
  UNION SELECT target_symbol_id, {LOCS}, 1 FROM f_span_refs
  UNION SELECT c.symbol_id, d.path, d.line, d.column_no, d.end_line, d.end_column, 2 FROM callers c JOIN f_span_decls d ON d.symbol_id = c.caller_id
  UNION SELECT c.caller_id, d.path, d.line, d.column_no, d.end_line, d.end_column, 3 FROM f_span_calls c JOIN f_span_decls d ON d.symbol_id = c.callee_id
  UNION SELECT i.s, d.path, d.line, d.column_no, d.end_line, d.end_column, 4 FROM impl i JOIN f_span_decls d ON d.symbol_id = i.o),
affected AS (SELECT c.change_id, c.symbol_id, e.path, list_sort(list_distinct(list(['contains-changed-symbol', 'references-changed-symbol', 'caller-of-changed-symbol', 'callee-of-changed-symbol', 'implements-changed-symbol'][r + 1]))) AS reasons,
  CASE WHEN min(r) <= 1 THEN 'direct' ELSE 'indirect' END AS impact_level, count(DISTINCT ROW({LOCS})) AS location_count FROM changed_symbols c JOIN evidence e ON e.symbol_id = c.symbol_id GROUP BY ALL)"""


@query("impact_diff", "change_id s, target_id s, path s, reasons a, impact_level s, location_count i", f"""
WITH {IMPACT}
SELECT_RESULT
SELECT change_id, symbol_id AS target_id, path, reasons, impact_level, location_count FROM affected""")
def _(f):
    return changes.impact_diff(changed(f)["symbols"], f.f_span_decls, f.f_span_refs, f.f_span_calls, f.f_span_types)


REVIEW = f"""{IMPACT},
scope AS (SELECT change_id, path FROM f_files UNION SELECT change_id, path FROM affected),
touched AS (SELECT DISTINCT change_id, project FROM scope s JOIN f_diags d ON d.path = s.path),
in_scope AS (SELECT change_id, d.*, 'diagnostic-in-diff-scope' AS reason FROM scope s JOIN f_diags d ON d.path = s.path
  UNION ALL SELECT change_id, d.*, 'project-diagnostic-in-touched-project' FROM touched t JOIN f_diags d ON d.project = t.project AND d.path IS NULL)"""


def review(f):
    return changes.review_diff(
        f.f_files, f.f_hunks, f.f_diags.filter("path IS NOT NULL"), f.f_span_decls, f.f_span_refs, f.f_span_calls, f.f_span_types, f.f_diags
    )


@query("diagnostics_diff", "change_id s, event_id i, reason s", f"""
WITH {REVIEW}
SELECT_RESULT
SELECT change_id, event_id, reason FROM in_scope""")
def _(f):
    return review(f)["diagnostics"]


@query("review_diff", "change_id s, code s, severity s, symbol_id s, path s, line i, call_count i, code_rank i", f"""
WITH {REVIEW}, called AS (SELECT cs.change_id, cs.symbol_id, least(count(DISTINCT ROW(path, line, column_no)), 5) AS n FROM changed_symbols cs JOIN callers c ON c.symbol_id = cs.symbol_id GROUP BY cs.change_id, cs.symbol_id)
SELECT_RESULT
SELECT change_id, 'changed-scope-has-diagnostic' AS code, CASE severity WHEN 'Error' THEN 'error' ELSE 'warning' END AS severity, NULL AS symbol_id, path, line, 0 AS call_count, 0 AS code_rank FROM in_scope
UNION ALL SELECT change_id, 'changed-public-symbol', 'info', c.symbol_id, path, line, 0, 1 FROM changed_symbols c JOIN f_span_decls d ON d.symbol_id = c.symbol_id WHERE accessibility IN ('Public', 'Protected')
UNION ALL SELECT change_id, 'changed-symbol-has-callers', 'info', c.symbol_id, path, line, n, 2 FROM called c JOIN f_span_decls d ON d.symbol_id = c.symbol_id""")
def _(f):
    return review(f)["findings"].withColumn("call_count", F.size("call_places"))


@query("where_used", "target_id s, path s, line i, containing_symbol_id s, position i, total i", f"""
WITH u AS (SELECT DISTINCT target_symbol_id AS target_id, {LOCS} FROM f_span_refs WHERE target_symbol_id IN (SELECT symbol_id FROM f_span_decls)),
inn AS (SELECT p.path, p.line, (min(ROW(s.end_line - s.line, s.symbol_id)))[2] AS sym FROM (SELECT DISTINCT path, line FROM u) p JOIN f_span_decls s ON s.path = p.path AND p.line BETWEEN s.line AND s.end_line GROUP BY ALL),
placed AS (SELECT u.*, sym, row_number() OVER (PARTITION BY target_id ORDER BY {', '.join('u.' + c.strip() for c in LOCS.split(','))}) AS position, count(*) OVER (PARTITION BY target_id) AS total FROM u LEFT JOIN inn ON inn.path = u.path AND inn.line = u.line)
SELECT_RESULT
SELECT target_id, path, line, sym AS containing_symbol_id, position, total FROM placed WHERE position <= 15""")
def _(f):
    chosen = f.f_span_decls.select(F.col("symbol_id").alias("target_id"), "symbol_id")
    return lookup.where_used(chosen, f.f_span_refs, f.f_span_decls, {"file": "path", "containing-symbol": "containing_symbol_id"}, 15)["references"]


@query("where_used_files", "target_id s, path s, reference_count i, kinds a, position i, total i, truncated b", f"""
WITH u AS (SELECT DISTINCT target_symbol_id AS target_id, {LOCS} FROM f_span_refs WHERE target_symbol_id IN (SELECT symbol_id FROM f_span_decls)),
files AS (SELECT target_id, path, count(*) AS reference_count FROM u GROUP BY target_id, path),
placed AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY reference_count DESC, path) AS position, count(*) OVER (PARTITION BY target_id) AS total FROM files)
SELECT_RESULT
SELECT target_id, path, reference_count, [concat('read:', CAST(reference_count AS VARCHAR))] AS kinds, position, total, total > 4 AS truncated FROM placed WHERE position <= 4""")
def _(f):
    chosen = f.f_span_decls.select(F.col("symbol_id").alias("target_id"), "symbol_id")
    files = lookup.where_used(chosen, f.f_span_refs, f.f_span_decls, {"file": "path"}, 15, 4)["files"]
    return files.withColumn("kinds", F.transform(F.map_entries("usage_kind_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))


# What lies around the asked symbols: chosen(target_id, symbol_id) comes before it.
WALKS = ", ".join([_walk("override", "o"), _walk("'override','implements'", "om"), _walk("'base','interface','override','implements'", "y"), _walk("base", "b"), _walk("'base','interface'", "x")])
AROUND = f"""
{WALKS},
root AS (SELECT c.target_id, d.* FROM chosen c JOIN f_decls d ON d.symbol_id = c.symbol_id),
callable AS (SELECT target_id, symbol_id FROM root WHERE kind IN ('Method', 'Property')),
members AS (SELECT t.target_id, m.* FROM root t JOIN f_decls m ON m.path = t.path AND (m.container = t.fqn OR starts_with(m.container, concat(t.fqn, '.'))) WHERE t.kind = 'NamedType' AND (m.line <> t.line OR m.column_no <> t.column_no)),
uses AS (SELECT DISTINCT c.target_id, {LOCS} FROM chosen c JOIN f_refs r ON r.target_symbol_id = c.symbol_id),
kin AS (SELECT target_id, symbol_id AS node FROM callable UNION SELECT c.target_id, high FROM callable c JOIN o ON low = c.symbol_id UNION SELECT c.target_id, low FROM callable c JOIN om ON high = c.symbol_id
  UNION SELECT c.target_id, parent_id FROM callable c JOIN f_types t ON child_id = c.symbol_id AND edge_kind = 'implements'),
caller_places AS (SELECT DISTINCT k.target_id, caller_id, {LOCS} FROM kin k JOIN f_calls c ON c.callee_id = k.node),
callees AS (SELECT DISTINCT target_id, callee_id FROM callable a JOIN f_calls c ON c.caller_id = a.symbol_id),
impls AS (SELECT c.target_id, low, min(depth) AS depth FROM chosen c JOIN y ON high = c.symbol_id WHERE low <> high GROUP BY ALL),
kin_types AS (SELECT c.target_id, 'derived-type' AS relation, low AS node, min(depth) AS depth FROM chosen c JOIN b ON high = c.symbol_id WHERE low <> high GROUP BY ALL
  UNION ALL SELECT c.target_id, 'implementing-type', low, min(depth) FROM chosen c JOIN x ON high = c.symbol_id WHERE low <> high AND high IN (SELECT parent_id FROM f_types WHERE edge_kind = 'interface') GROUP BY ALL
  UNION ALL SELECT c.target_id, 'base-type', high, min(depth) FROM chosen c JOIN b ON low = c.symbol_id WHERE low <> high GROUP BY ALL
  UNION ALL SELECT DISTINCT c.target_id, 'interface', parent_id, 1 FROM chosen c JOIN f_types ON child_id = c.symbol_id WHERE edge_kind = 'interface' AND child_id <> parent_id
  UNION ALL SELECT c.target_id, 'base-member', high, min(depth) FROM chosen c JOIN o ON low = c.symbol_id WHERE low <> high GROUP BY ALL
  UNION ALL SELECT c.target_id, 'overriding-member', low, min(depth) FROM chosen c JOIN o ON high = c.symbol_id WHERE low <> high GROUP BY ALL
  UNION ALL SELECT c.target_id, 'implemented-member', low, min(depth) FROM chosen c JOIN (SELECT child_id AS low, parent_id AS high, 1 AS depth FROM f_types WHERE edge_kind = 'implements') m1 ON high = c.symbol_id WHERE low <> high GROUP BY ALL)"""


@query("about_symbols", "target_id s, part s, symbol_id s, position i, total i, truncated b", f"""
WITH RECURSIVE chosen AS (SELECT * FROM f_asked), {AROUND}, {_walk("implements", "im")},
calls AS (SELECT a.target_id, callee_id, min(ROW({LOCS})) AS first FROM callable a JOIN f_calls c ON c.caller_id = a.symbol_id GROUP BY ALL),
callers AS (SELECT target_id, caller_id, min(ROW({LOCS})) AS first FROM caller_places GROUP BY ALL),
relations AS (SELECT target_id, relation, node, depth FROM kin_types WHERE relation <> 'implemented-member'
  UNION ALL SELECT c.target_id, 'implemented-member', low, min(depth) FROM chosen c JOIN im ON high = c.symbol_id WHERE low <> high GROUP BY ALL),
p AS (SELECT target_id, 'member' AS part, symbol_id, row_number() OVER (PARTITION BY target_id ORDER BY line, column_no, symbol_id) AS position, count(*) OVER (PARTITION BY target_id) AS total FROM members
  UNION ALL SELECT target_id, 'call', callee_id, row_number() OVER (PARTITION BY target_id ORDER BY first, callee_id), count(*) OVER (PARTITION BY target_id) FROM calls
  UNION ALL SELECT target_id, 'caller', caller_id, row_number() OVER (PARTITION BY target_id ORDER BY first, caller_id), count(*) OVER (PARTITION BY target_id) FROM callers
  UNION ALL SELECT target_id, 'implementation', low, row_number() OVER (PARTITION BY target_id ORDER BY depth, low), count(*) OVER (PARTITION BY target_id) FROM impls
  UNION ALL SELECT target_id, relation, node, row_number() OVER (PARTITION BY target_id, relation ORDER BY depth, node), count(*) OVER (PARTITION BY target_id, relation) FROM relations)
SELECT_RESULT
SELECT target_id, part, symbol_id, position, total, total > 3 AS truncated FROM p WHERE position <= 3""")
def _(f):
    found = lookup.about(f.f_asked, f.f_decls.filter("trim(name) <> ''"), f.f_refs, f.f_calls, f.f_types, limit=3)
    pick = lambda name, part, c: found[name].select("target_id", part.alias("part"), F.col(c).alias("symbol_id"), "position", "total", "truncated")
    parts = [("members", "member", "symbol_id"), ("calls", "call", "callee_id"), ("callers", "caller", "caller_id"), ("implementations", "implementation", "symbol_id")]
    rows = pick("hierarchy", F.col("relation"), "symbol_id")
    for name, part, column in parts:
        rows = rows.unionByName(pick(name, F.lit(part), column))
    return rows


# A text per path: the document that the path's last number names.
PATH_TEXTS = """
SELECT path, text FROM (SELECT path, CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS n FROM (SELECT path FROM f_decls UNION SELECT path FROM f_refs) a) p JOIN documents ON doc_id = n"""
# Diagnostics of orders, in files that refer to the symbols.
ORDER_DIAGS = """
SELECT 'App' AS project, 'Warning' AS severity, concat('CS', CAST(o_orderkey % 90 AS {0})) AS id, o_orderpriority AS message, concat('src/N/o', CAST(o_orderkey % 500 AS {0}), '.cs') AS path,
  CAST(o_orderkey % 70 AS INT) AS line, 1 AS column_no, CAST(o_orderkey % 70 AS INT) AS end_line, 9 AS end_column FROM orders"""
ORDER_OF_KINDS = "CASE kind WHEN 'definition' THEN 0 WHEN 'member' THEN 1 WHEN 'caller' THEN 2 WHEN 'call' THEN 3 WHEN 'implementation' THEN 4 WHEN 'reference' THEN 5 WHEN 'diagnostic' THEN 6 ELSE 7 END"
SYMBOL_PACK = f"""{AROUND}, diags AS ({ORDER_DIAGS.format('VARCHAR')}), texts AS ({PATH_TEXTS}),
evidence AS (
  SELECT target_id, {LOCS}, 0 AS r FROM root UNION ALL SELECT target_id, {LOCS}, 1 FROM uses UNION ALL SELECT target_id, {LOCS}, 2 FROM caller_places
  UNION ALL SELECT target_id, {LOCS}, 3 FROM impls JOIN f_decls d ON d.symbol_id = low
  UNION ALL SELECT target_id, {LOCS}, 4 FROM kin_types JOIN f_decls d ON d.symbol_id = node WHERE relation IN ('derived-type', 'implementing-type')
  UNION ALL SELECT target_id, {LOCS}, 5 FROM callees JOIN f_decls d ON d.symbol_id = callee_id),
files AS (SELECT target_id, path, {REASONS}[min(r) + 1] AS reason, min(ROW(line, column_no, end_line, end_column)) AS p FROM evidence GROUP BY target_id, path),
raw AS (
  SELECT target_id, 'definition' AS kind, 'selected-symbol-definition' AS reason, {LOCS}, name AS suffix, CAST(NULL AS VARCHAR) AS message FROM root
  UNION ALL SELECT target_id, 'member', 'member-outline-entry', {LOCS}, name, NULL FROM members
  UNION ALL SELECT target_id, 'reference', 'references-selected-symbol', {LOCS}, NULL, NULL FROM uses
  UNION ALL SELECT target_id, 'related-file', reason, path, p[1], p[2], p[3], p[4], NULL, NULL FROM files
  UNION ALL SELECT target_id, 'caller', 'caller-of-selected-symbol', {LOCS}, name, NULL FROM (SELECT DISTINCT target_id, caller_id FROM caller_places) c JOIN f_decls d ON d.symbol_id = caller_id
  UNION ALL SELECT target_id, 'call', 'callee-of-selected-symbol', {LOCS}, name, NULL FROM callees JOIN f_decls d ON d.symbol_id = callee_id
  UNION ALL SELECT target_id, 'implementation', 'implements-selected-symbol', {LOCS}, name, NULL FROM impls JOIN f_decls d ON d.symbol_id = low
  UNION ALL SELECT target_id, 'diagnostic', 'diagnostic-in-context', g.path, line, column_no, end_line, end_column, id, message FROM (SELECT target_id, path FROM files UNION SELECT target_id, path FROM uses UNION SELECT target_id, path FROM root) s JOIN diags g ON g.path = s.path),
ided AS (SELECT target_id AS pack_id, kind, {LOCS}, concat_ws(':', kind, coalesce(path, ''), coalesce(CAST(line AS VARCHAR), ''), coalesce(CAST(column_no AS VARCHAR), ''), coalesce(CAST(end_line AS VARCHAR), ''), coalesce(CAST(end_column AS VARCHAR), ''), coalesce(suffix, '')) AS item_id,
  min(reason) AS reason, min(message) AS message FROM raw GROUP BY ALL),
placed_items AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY {ORDER_OF_KINDS}, path NULLS FIRST, line NULLS FIRST, column_no NULLS FIRST, end_line NULLS FIRST, end_column NULLS FIRST, kind, item_id) AS position FROM ided),
split_texts AS (SELECT path, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM texts),
costed AS (SELECT i.*, coalesce(length(message), CASE WHEN line >= 1 THEN length(ls[line]) END, 0) + length(i.path) + length(kind) + length(reason) AS chars
  FROM placed_items i LEFT JOIN split_texts t ON t.path = i.path WHERE position <= PACK_LIMIT),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY pack_id ORDER BY position) AS run FROM costed),
ends AS (SELECT pack_id, min(position) FILTER (run > PACK_CHARS) AS over_at FROM summed GROUP BY pack_id),
kept_items AS (SELECT s.*, run <= PACK_CHARS AS has_content FROM summed s JOIN ends e ON e.pack_id = s.pack_id WHERE position <= coalesce(over_at, PACK_LIMIT))"""


def _pack_sql(limit: int, tokens: int) -> str:
    return SYMBOL_PACK.replace("PACK_LIMIT", str(limit)).replace("PACK_CHARS", str(4 * tokens))


def symbol_pack(f, limit: int, tokens: int):
    items = context.query_items(f.f_asked, f.f_decls, f.f_refs, f.f_calls, f.f_types, f.sql(ORDER_DIAGS.format("STRING")), limit)
    return context.context_pack(items, f.sql(PATH_TEXTS), "modify", budget_tokens=tokens, item_limit=limit)


@query("context_pack_of_symbols", "pack_id s, item_id s, position i, running_chars i, has_content b", f"""
WITH RECURSIVE chosen AS (SELECT * FROM f_asked), {_pack_sql(12, 600)}
SELECT_RESULT
SELECT pack_id, item_id, position, run AS running_chars, has_content FROM kept_items""")
def _(f):
    return symbol_pack(f, 12, 600)["items"]


@query("context_pack_sections", "pack_id s, kind s, total i, included i, truncated b", f"""
WITH RECURSIVE chosen AS (SELECT * FROM f_asked), {_pack_sql(12, 600)},
totals AS (SELECT pack_id, kind, count(*) AS total FROM ided GROUP BY ALL), inc AS (SELECT pack_id, kind, count(*) AS included FROM kept_items GROUP BY ALL)
SELECT_RESULT
SELECT t.pack_id, t.kind, total, coalesce(included, 0) AS included, total > coalesce(included, 0) AS truncated FROM totals t LEFT JOIN inc i ON i.pack_id = t.pack_id AND i.kind = t.kind""")
def _(f):
    return symbol_pack(f, 12, 600)["sections"]


def _lines(f):
    """A text per path of the span facts: one line per minute."""
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1440)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    return f.f_span_decls.select("path").distinct().withColumn("text", lines)


PACK = f"""{REVIEW},
src AS (SELECT DISTINCT path FROM f_span_decls),
raw AS (
  SELECT c.change_id AS pack_id, 'changed-symbol' AS kind, 'changed-symbol' AS reason, {LOCS}, d.name AS suffix FROM changed_symbols c JOIN f_span_decls d ON d.symbol_id = c.symbol_id
  UNION ALL SELECT change_id, 'finding', 'changed-scope-has-diagnostic', {LOCS}, 'changed-scope-has-diagnostic' FROM in_scope
  UNION ALL SELECT change_id, 'finding', 'changed-public-symbol', {LOCS}, 'changed-public-symbol' FROM changed_symbols c JOIN f_span_decls d ON d.symbol_id = c.symbol_id WHERE accessibility IN ('Public', 'Protected')
  UNION ALL SELECT change_id, 'finding', 'changed-symbol-has-callers', {LOCS}, 'changed-symbol-has-callers' FROM changed_symbols c JOIN f_span_decls d ON d.symbol_id = c.symbol_id WHERE c.symbol_id IN (SELECT symbol_id FROM callers)
  UNION ALL SELECT change_id, 'diagnostic', reason, {LOCS}, id FROM in_scope),
ided AS (SELECT DISTINCT pack_id, kind, reason, path, line, column_no, end_line, end_column, concat_ws(':', kind, coalesce(path, ''), coalesce(CAST(line AS VARCHAR), ''), coalesce(CAST(column_no AS VARCHAR), ''), coalesce(CAST(end_line AS VARCHAR), ''), coalesce(CAST(end_column AS VARCHAR), ''), suffix) AS item_id FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY CASE kind WHEN 'changed-symbol' THEN 0 WHEN 'finding' THEN 1 ELSE 2 END, path NULLS FIRST, line NULLS FIRST, column_no NULLS FIRST, end_line NULLS FIRST, end_column NULLS FIRST, kind, item_id) AS position FROM ided),
costed AS (SELECT p.*, CASE WHEN s.path IS NOT NULL AND line BETWEEN 1 AND 1440 THEN length(concat('line ', CAST(line AS VARCHAR))) ELSE 0 END + coalesce(length(p.path), 0) + length(kind) + length(reason) AS chars FROM placed p LEFT JOIN src s ON s.path = p.path),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY pack_id ORDER BY position) AS run FROM costed)"""


@query("context_pack_of_changes", "pack_id s, item_id s, position i, running_chars i, has_content b", f"""
WITH {PACK}
SELECT_RESULT
SELECT pack_id, item_id, position, run AS running_chars, true AS has_content FROM summed WHERE position <= 30 AND run <= 16000""")
def _(f):
    return context.context_pack(context.diff_items(review(f)), _lines(f), "review", budget_tokens=4000, item_limit=30)["items"]


@query("diagnostic_pack", "target_id s, part s, symbol_id s, place i", f"""
WITH {AT}, rep AS (SELECT target_id, path, line FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY path, line, column_no, project, id, severity, message) AS rn FROM located WHERE path IS NOT NULL) x WHERE rn = 1),
inn AS (SELECT p.path, p.line, (min(ROW(s.end_line - s.line, s.symbol_id)))[2] AS sym FROM (SELECT DISTINCT path, line FROM rep) p JOIN f_span_decls s ON s.path = p.path AND p.line BETWEEN s.line AND s.end_line GROUP BY ALL)
SELECT_RESULT
SELECT r.target_id, 'scope' AS part, s.symbol_id, row_number() OVER (PARTITION BY r.target_id ORDER BY s.line, s.end_line DESC, s.symbol_id) AS place FROM rep r JOIN f_span_decls s ON s.path = r.path AND r.line BETWEEN s.line AND s.end_line
UNION ALL SELECT r.target_id, 'slice', sym, least(40, (SELECT end_line - line + 1 FROM f_span_decls d WHERE d.symbol_id = sym)) FROM rep r JOIN inn i ON i.path = r.path AND i.line = r.line""")
def _(f):
    from .spans import _asked

    found = context.diagnostic_pack(_asked(f), f.f_diags, f.f_span_decls, _lines(f))
    scopes = found["scopes"].select("target_id", F.lit("scope").alias("part"), "symbol_id", F.col("depth").alias("place"))
    slices = found["slices"].select("target_id", F.lit("slice").alias("part"), "symbol_id", F.array_size("lines").alias("place"))
    return scopes.unionByName(slices)


# Tests that name a chosen symbol's type or lie in a file that names it.
NAMING_TESTS = f"""
tt AS (SELECT DISTINCT project, path, line, name, container FROM ({TESTS.format('VARCHAR')}) x WHERE ak < 3),
subjects AS (SELECT target_id, lower(CASE WHEN kind = 'NamedType' THEN name ELSE string_split(container, '.')[-1] END) AS tn, lower(name) AS nn FROM root),
tested AS (SELECT DISTINCT target_id FROM subjects JOIN tt ON (tn <> '' AND (contains(lower(tt.container), tn) OR contains(lower(tt.name), tn))) OR (nn <> '' AND contains(lower(tt.path), nn)))"""


@query("edit_preflight", "target_id s, overall s, risk_level s, risk_reasons a, known_unknowns a", f"""
WITH RECURSIVE {RANKED_NAMES}, {CHOSEN.split(",\nchosen AS")[0]},
pre AS (SELECT target_id, total_candidates, confidence, confidence IN ('high', 'medium', 'low') AS selected, best, CASE WHEN confidence = 'ambiguous' THEN 'same-rank-candidates' END AS ambiguity FROM judged),
chosen AS (SELECT target_id, best AS symbol_id FROM pre WHERE selected), {_pack_sql(20, 4000)}, {NAMING_TESTS},
packs AS (SELECT i.pack_id, bool_or(over_at IS NOT NULL) OR count(*) > any_value(kept) AS cut FROM ided i JOIN ends e ON e.pack_id = i.pack_id JOIN (SELECT pack_id, count(*) AS kept FROM kept_items GROUP BY pack_id) k ON k.pack_id = i.pack_id GROUP BY i.pack_id),
facts AS (SELECT pre.*, coalesce(cut, false) AS cut, t.target_id IS NOT NULL AS tests FROM pre LEFT JOIN packs ON pack_id = pre.target_id LEFT JOIN tested t ON t.target_id = pre.target_id)
SELECT_RESULT
SELECT target_id, CASE WHEN selected THEN confidence ELSE 'none' END AS overall, CASE WHEN NOT selected THEN 'high' WHEN cut THEN 'medium' ELSE 'low' END AS risk_level,
 list_sort(list_filter([CASE WHEN NOT selected THEN 'no-selected-target' END, ambiguity, CASE WHEN cut THEN 'context-truncated' END, CASE WHEN NOT tests THEN 'no-related-tests-found' END], lambda z: z IS NOT NULL)) AS risk_reasons,
 list_sort(list_filter([CASE WHEN total_candidates > 1 THEN 'multiple-candidates-existed-before-selection' END, CASE WHEN cut THEN 'context-pack-truncated-by-budget' END, CASE WHEN NOT tests THEN 'related-tests-not-proven' END, 'runtime-behavior-not-proven'], lambda z: z IS NOT NULL)) AS known_unknowns FROM facts""")
def _(f):
    diags = f.sql(ORDER_DIAGS.format("STRING"))
    found = context.edit_preflight(targets(f), f.f_decls, f.f_refs, f.f_calls, f.f_types, diags, f.sql(PATH_TEXTS), tests(f), item_limit=20)
    return found["ledger"]


@query("symbol_list", "position i, symbol_id s, path s, total i, truncated b", """
SELECT position, symbol_id, path, total, total > 40 AS truncated FROM (SELECT *, row_number() OVER (ORDER BY path, line, column_no, name, symbol_id) AS position, count(*) OVER () AS total FROM f_decls
  WHERE contains(lower(name), 'r') AND kind = 'Method' AND NOT contains(path, '/obj/') AND NOT path LIKE '%.g.cs') x WHERE position <= 40""")
def _(f):
    return repositories.symbols(f.f_decls, None, "R", limit=40, kinds=["Method"])


@query("diagnostic_list", "position i, event_id i, total i, truncated b", """
SELECT position, event_id, total, total > 60 AS truncated FROM (SELECT *, row_number() OVER (ORDER BY project, path NULLS FIRST, line NULLS FIRST, column_no, end_line NULLS FIRST, end_column, severity, id, message) AS position, count(*) OVER () AS total FROM f_diags
  WHERE severity = 'Warning' AND project IN ('App1', 'App2')) x WHERE position <= 60""")
def _(f):
    chosen = f.sql("SELECT concat('App', CAST(r_regionkey AS STRING)) AS project FROM region WHERE r_regionkey IN (1, 2)")
    return repositories.diagnostics(f.f_diags, chosen, ["Warning"], limit=60)


@query("workspace_overview", "repo s, documents i, distinct_paths i, status s, stale_reasons a", """
SELECT repo, count(*) AS documents, count(DISTINCT path) AS distinct_paths, CASE WHEN repo = 'en' THEN 'missing' ELSE 'stale' END AS status, CASE WHEN repo = 'en' THEN [] WHEN repo = 'fr' THEN ['path-changed', 'fingerprint-changed'] ELSE ['fingerprint-changed'] END AS stale_reasons FROM f_docs GROUP BY repo""")
def _(f):
    docs = f.f_docs.withColumn("modified_at", F.timestamp_seconds("doc_id"))
    cached = f.f_docs.select("repo").distinct().filter("repo <> 'en'").select(
        "repo", F.lit(1).alias("schema_version"), F.when(F.col("repo") == "fr", "elsewhere").otherwise(F.col("repo")).alias("path"), F.lit("old").alias("fingerprint")
    )
    return repositories.overview(docs, cached)


@query("review_pack", "position i, rule_id s, path s, line i, total i, truncated b", f"""
WITH {FOUND}, scoped AS (SELECT * FROM allf WHERE path IN (SELECT concat('src/o', CAST(o_orderkey % 2000 AS VARCHAR), '.cs') FROM orders WHERE o_orderstatus = 'P')),
placed AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'warning' THEN 1 ELSE 2 END, CASE confidence WHEN 'high' THEN 0 ELSE 1 END, pack, rule_id, path, line, col) AS position, count(*) OVER () AS total FROM scoped)
SELECT_RESULT
SELECT position, rule_id, path, line, total, total > 100 AS truncated FROM placed WHERE position <= 100""")
def _(f):
    scope = f.sql("SELECT DISTINCT concat('src/o', CAST(o_orderkey % 2000 AS STRING), '.cs') AS path FROM orders WHERE o_orderstatus = 'P'")
    return changes.review_pack([async_findings(f), security_findings(f)], 100, scope)["findings"]


@query("public_api_diff", "total_changes i, source_breaking i, binary_breaking i, additions i, removals i, signature_changes i", f"""
WITH {COMPARE}
SELECT_RESULT
SELECT count(*) AS total_changes, count(*) FILTER (source_risk = 'breaking') AS source_breaking, count(*) FILTER (binary_risk = 'breaking') AS binary_breaking,
 count(*) FILTER (change = 'addition') AS additions, count(*) FILTER (change = 'removal') AS removals, count(*) FILTER (code = 'public-signature-changed') AS signature_changes FROM risked""")
def _(f):
    base, head = sides(f)
    return repositories.public_api_diff(base, head)["summary"]
