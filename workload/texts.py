"""Documents, paths, manifests, text search, context budgets and source slices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factspan.functions import names, paths
from factspan.operators import budget, core, ranking
from factspan.session import cut_lineage, shared_folder
from factspan.sources import documents, text_index

from .registry import query

GENERATED = "regexp_matches(path, '(?i)\\.(g|generated|designer|AssemblyInfo|AssemblyAttributes)\\.(cs|vb)$') OR regexp_matches(path, '(?i)(^|[/\\\\])(obj|bin)([/\\\\]|$)')"
LINES = "CASE WHEN ends_with(t, chr(10)) OR t = '' THEN list_slice(string_split(t, chr(10)), 1, len(string_split(t, chr(10))) - 1) ELSE string_split(t, chr(10)) END"
SPLIT = f"split_docs AS (SELECT doc_id, path, {LINES} AS ls FROM (SELECT doc_id, path, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM f_docs) d)"


@query("document_index", "doc_key s, rel_path s, file_name s", """
SELECT doc_key, CASE WHEN starts_with(path, '/work/en/') THEN substr(path, 10) END AS rel_path, list_extract(string_split(path, '/'), -1) AS file_name FROM f_docs""")
def _(f):
    return documents.document_index(f.f_docs, "/work/en")


INDEX = "idx AS (SELECT doc_key, path, project, CASE WHEN starts_with(path, '/work/en/') THEN substr(path, 10) END AS rel_path FROM f_docs)"
ASKED = """
SELECT concat('r', CAST(c_custkey AS {s})) AS request_id, CASE c_custkey % 3 WHEN 0 THEN concat('/work/en/src', CAST(c_custkey % 20 AS {s}), '/doc', CAST(c_custkey % 400 AS {s}), '.cs')
  ELSE concat('src', CAST(c_custkey % 20 AS {s}), '/doc', CAST(c_custkey % 400 AS {s}), '.cs') END AS request_path,
  CASE WHEN c_custkey % 2 = 0 THEN concat('src', CAST(c_custkey % 20 AS {s})) END AS request_project FROM customer"""


@query("document_lookup", "request_id s, request_path s, path s, project s, doc_id s", f"""
WITH {INDEX}, asked AS ({ASKED.format(s='VARCHAR')}),
hits AS (SELECT request_id, 0 AS k, path, project, doc_key FROM asked JOIN idx ON path = request_path AND (request_project IS NULL OR request_project = project)
  UNION ALL SELECT request_id, 1, path, project, doc_key FROM asked JOIN idx ON rel_path = request_path AND (request_project IS NULL OR request_project = project)),
best AS (SELECT request_id, min(ROW(k, path, project, doc_key)) AS b FROM hits GROUP BY request_id)
SELECT_RESULT
SELECT a.request_id, request_path, b[2] AS path, b[3] AS project, b[4] AS doc_id FROM asked a LEFT JOIN best x ON x.request_id = a.request_id""")
def _(f):
    index = documents.document_index(f.f_docs.drop("doc_id").withColumnRenamed("doc_key", "doc_id"), "/work/en")
    return documents.document_lookup(f.sql(ASKED.format(s="STRING")), index)


@query("document_stats", "repo s, documents i, distinct_paths i, distinct_names i, size_estimate i", """
SELECT repo, count(*) AS documents, count(DISTINCT path) AS distinct_paths, count(DISTINCT list_extract(string_split(path, '/'), -1)) AS distinct_names,
  128 * count(*) + 2 * sum(length(text)) AS size_estimate FROM f_docs GROUP BY repo""")
def _(f):
    return documents.document_stats(f.f_docs)


@query("path_functions", "doc_key s, generated b, source b, kind s, dir s, clean s", f"""
SELECT doc_key, {GENERATED} AS generated, regexp_matches(path, '(?i)\\.(cs|vb)$') AS source, CASE WHEN contains(lower(project), 'test') OR contains(lower(path), 'doc1') THEN 'test' ELSE 'production' END AS kind,
  regexp_replace(path, '/[^/]*$', '') AS dir, concat('a', path) AS clean FROM f_docs""")
def _(f):
    quoted = F.concat(F.lit('"a'), F.regexp_replace("path", "/", "\\\\\\\\"), F.lit('"'))
    return f.f_docs.select(
        "doc_key", paths.is_generated_path("path").alias("generated"), paths.is_source_path("path").alias("source"),
        paths.project_kind("project", F.regexp_replace("path", "doc1", "test")).alias("kind"),
        paths.directory("path").alias("dir"), F.regexp_replace(paths.normalize_path(quoted), "^/", "").alias("clean"),
    )


@query("route_functions", "page_id i, route s, combined s, squeezed s", """
SELECT page_id, regexp_replace(concat('/', url), '/+', '/', 'g') AS route, concat(rtrim(split_part(url, '?', 1), '/'), '/', ltrim(split_part(url, '?', 2), '/')) AS raw,
 CASE WHEN split_part(url, '?', 2) = '' THEN split_part(url, '?', 1) ELSE concat(rtrim(split_part(url, '?', 1), '/'), '/', ltrim(split_part(url, '?', 2), '/')) END AS combined,
 trim(regexp_replace(html, '\\s+', ' ', 'g')) AS squeezed FROM pages""")
def _(f):
    left, right = F.split_part("url", F.lit("?"), F.lit(1)), F.split_part("url", F.lit("?"), F.lit(2))
    return f.pages.select(
        "page_id", paths.normalize_route("url").alias("route"), paths.combine_routes(left, right).alias("combined"),
        names.collapse_whitespace("html").alias("squeezed"),
    )


@query("snapshot_files", "doc_key s, path s", f"""
SELECT doc_key, path FROM f_docs WHERE repo = 'en' AND regexp_matches(path, '(?i)\\.(cs|vb)$') AND NOT ({GENERATED})""")
def _(f):
    return documents.snapshot_files(f.f_docs.withColumn("ref", F.col("repo")), "en")


def _dated(f):
    return f.f_docs.withColumn("modified_at", F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")))


@query("manifest", "repo s, path s, length i, sha256 s", "SELECT repo, path, length(text) AS length, sha256(text) AS sha256 FROM f_docs")
def _(f):
    return documents.manifest(_dated(f))


@query("workspace_fingerprints", "repo s, row_count i, fingerprint s", """
SELECT repo, count(*) AS row_count, sha256(concat(repo, chr(10), string_agg(concat_ws('|', path, CAST(length(text) AS VARCHAR), sha256(text)), chr(10) ORDER BY path, concat_ws('|', path, CAST(length(text) AS VARCHAR), sha256(text))))) AS fingerprint
FROM f_docs GROUP BY repo""")
def _(f):
    return documents.workspace_fingerprints(_dated(f))


STATUS = """
SELECT concat(n_name, '') AS repo, 1 + n_nationkey % 2 AS schema_version, concat('/w/', n_name) AS path, concat('f', CAST(n_regionkey AS {s})) AS fingerprint FROM nation"""
CACHED = """
SELECT n_name AS repo, 1 AS schema_version, concat('/w/', CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE n_name END) AS path, concat('f', CAST(n_nationkey % 4 AS {s})) AS fingerprint FROM nation WHERE n_nationkey % 5 <> 0"""


@query("manifest_status", "repo s, status s, stale_reasons a", f"""
WITH cur AS ({STATUS.format(s='VARCHAR')}), old AS ({CACHED.format(s='VARCHAR')}),
j AS (SELECT cur.repo, old.repo IS NULL AS missing, list_filter([CASE WHEN cur.schema_version <> old.schema_version THEN 'schema-changed' END, CASE WHEN cur.path <> old.path THEN 'path-changed' END,
  CASE WHEN cur.fingerprint <> old.fingerprint THEN 'fingerprint-changed' END], lambda x: x IS NOT NULL) AS r FROM cur LEFT JOIN old ON old.repo = cur.repo)
SELECT_RESULT
SELECT repo, CASE WHEN missing THEN 'missing' WHEN len(r) > 0 THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN missing THEN [] ELSE r END AS stale_reasons FROM j""")
def _(f):
    return documents.manifest_status(f.sql(STATUS.format(s="STRING")), f.sql(CACHED.format(s="STRING")))


# Every benchmark item asks for its first word in the texts of a language; its own document is the one of its number.
TERMS = """
SELECT concat('b', CAST(item_id AS {s})) AS target_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS repo,
  CASE WHEN item_id % 9 = 0 THEN NULL WHEN item_id % 7 = 0 THEN 'Zzqx' ELSE split_part(text, ' ', 4) END AS term, concat('d', CAST(item_id AS {s})) AS own FROM benchmark"""
SCOPED = f"""
asked AS ({TERMS.format(s='VARCHAR')}),
scoped AS (SELECT a.target_id, d.doc_key, d.project, d.doc_key = a.own AS is_own, term IS NULL OR contains(text, term) AS hit FROM asked a JOIN f_docs d ON d.repo = a.repo),
flagged AS (SELECT *, bool_or(hit) OVER (PARTITION BY target_id) AS any_hit FROM scoped),
kept AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY is_own DESC, doc_key, project) AS position FROM flagged WHERE hit OR (NOT any_hit AND is_own)),
searched AS (SELECT * FROM kept WHERE position <= 30)"""


def _scope(f):
    asked = f.sql(TERMS.format(s="STRING")).withColumnRenamed("own", "own_key")
    docs = f.f_docs.select(F.col("repo").alias("scope_key"), "doc_key", "project", "text")
    return asked.drop("repo"), asked.select("target_id", F.col("repo").alias("scope_key")), docs


@query("lexical_prefilter", "target_id s, doc_key s, project s, is_own b, position i", f"""
WITH {SCOPED}
SELECT_RESULT
SELECT target_id, doc_key, project, is_own, position FROM searched""")
def _(f):
    return ranking.lexical_prefilter(*_scope(f), 30)


@query("lexical_prefilter_indexed", "target_id s, doc_key s, project s, is_own b, position i", f"""
WITH {SCOPED}
SELECT_RESULT
SELECT target_id, doc_key, project, is_own, position FROM searched""")
def _(f):
    """The same through a stored index that was built before: some documents were missing, some had other texts, some are gone since."""
    targets, scope, docs = _scope(f)
    number = F.expr("try_cast(substr(doc_key, 2) AS bigint)")
    before = docs.filter(number % 11 != 3).withColumn("text", F.when(number % 5 == 2, F.concat(F.lit("Zzqx "), F.reverse("text"))).otherwise(F.col("text")))
    before = before.unionByName(docs.withColumn("doc_key", F.concat(F.lit("gone-"), "doc_key")).filter(F.expr("try_cast(substr(doc_key, 7) AS bigint)") % 7 == 1))
    folder = f"{shared_folder(f.spark)}/texts-{uuid.uuid4().hex}"
    text_index.build(before, folder)
    text_index.refresh(docs, folder)
    return ranking.lexical_prefilter(targets, scope, docs, 30, folder)


@query("search_counters", "target_id s, candidate_documents i, candidate_projects i, prefiltered_documents i, searched_documents i, searched_projects i, partial b, truncation_reason s, next_scope s, cost_class s", f"""
WITH {SCOPED},
c AS (SELECT target_id, count(*) AS candidate_documents, count(DISTINCT project) AS candidate_projects, CASE WHEN bool_or(hit) THEN count(*) FILTER (hit) ELSE count(*) FILTER (is_own) END AS prefiltered_documents FROM scoped GROUP BY target_id),
s AS (SELECT target_id, count(*) AS searched_documents, count(DISTINCT project) AS searched_projects FROM searched GROUP BY target_id)
SELECT_RESULT
SELECT c.*, coalesce(searched_documents, 0) AS searched_documents, coalesce(searched_projects, 0) AS searched_projects, prefiltered_documents > coalesce(searched_documents, 0) AS partial,
 CASE WHEN prefiltered_documents > coalesce(searched_documents, 0) THEN 'document-budget' END AS truncation_reason, 'dependent-projects' AS next_scope, 'moderate' AS cost_class
FROM c LEFT JOIN s ON s.target_id = c.target_id""")
def _(f):
    return ranking.search_counters(*_scope(f), 30, "project")


# Context items: documents; pack = language and quality, kind by source, content = the lines of the text.
KIND = "CASE doc_id % 9 WHEN 0 THEN 'definition' WHEN 1 THEN 'member' WHEN 2 THEN 'reference' WHEN 3 THEN 'caller' WHEN 4 THEN 'diagnostic' WHEN 5 THEN 'related-file' WHEN 6 THEN 'call' WHEN 7 THEN 'implementation' ELSE 'other' END"
RANKED = f"""
{SPLIT},
raw AS (SELECT concat(lang, '/', CAST(coalesce(quality, 9) AS VARCHAR)) AS pack_id, concat({KIND.replace('doc_id', 'd.doc_id')}, ':', CAST(d.doc_id % 400 AS VARCHAR)) AS item_id, {KIND.replace('doc_id', 'd.doc_id')} AS kind, s.path, d.doc_id AS line,
  length(array_to_string(ls, '')) + length(s.path) + length({KIND.replace('doc_id', 'd.doc_id')}) + length(source) AS chars
  FROM documents d JOIN split_docs s ON s.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
uniq AS (SELECT pack_id, item_id, (min(ROW(kind, path, line, chars)) ) AS m FROM raw GROUP BY pack_id, item_id),
items AS (SELECT pack_id, item_id, m[1] AS kind, m[2] AS path, m[3] AS line, m[4] AS chars,
  CASE m[1] WHEN 'definition' THEN 0 WHEN 'member' THEN 1 WHEN 'implementation' THEN 2 WHEN 'reference' THEN 3 WHEN 'caller' THEN 4 WHEN 'diagnostic' THEN 5 ELSE 20 END AS priority FROM uniq),
placed AS (SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY priority, path, line, kind, item_id) AS position, count(*) OVER (PARTITION BY pack_id) AS total_items FROM items),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY pack_id ORDER BY position) AS run FROM placed),
firsts AS (SELECT *, min(CASE WHEN run > 120000 THEN position END) OVER (PARTITION BY pack_id) AS stop FROM summed),
included AS (SELECT * FROM firsts WHERE position <= 25 AND (stop IS NULL OR position <= stop))"""


def _items(f):
    raw = f.sql(
        f"SELECT concat(d.repo, '/', CAST(coalesce(quality, 9) AS STRING)) AS pack_id, concat({KIND.replace('doc_id', 'd.doc_id')}, ':', CAST(d.doc_id % 400 AS STRING)) AS item_id, "
        f"{KIND.replace('doc_id', 'd.doc_id')} AS kind, d.path, d.doc_id AS line, 1 AS column_no, d.doc_id AS end_line, 1 AS end_column, d.text, array(d.project) AS reason_codes "
        "FROM f_docs d LEFT JOIN labels l ON l.doc_id = d.doc_id"
    )
    # Texts are reduced to their cost before anything is shuffled.
    return budget.with_chars(raw.withColumn("lines", paths.lines_of("text"))).drop("text", "lines", "reason_codes")


def ranked_items(f):
    return budget.rank_context(_items(f), "modify", "signature")


@query("rank_context", "pack_id s, item_id s, kind s, priority i, line i, chars i", f"""
WITH {RANKED}
SELECT_RESULT
SELECT pack_id, item_id, kind, priority, line, chars FROM items""")
def _(f):
    return ranked_items(f)


@query("apply_budget", "pack_id s, item_id s, position i, running_chars i, has_content b, estimated_tokens i", f"""
WITH {RANKED}
SELECT_RESULT
SELECT pack_id, item_id, position, run AS running_chars, stop IS NULL OR position < stop AS has_content, CASE WHEN stop IS NULL OR position < stop THEN CAST(ceil(chars / 4.0) AS BIGINT) ELSE 0 END AS estimated_tokens FROM included""")
def _(f):
    return budget.apply_budget(ranked_items(f), 30000, 25)


@query("budget_summary", "pack_id s, total_items i, included i, chars_used i, tokens_used i, budget_truncated b, omitted_reason s, omitted_items i, first_omitted_id s", f"""
WITH {RANKED},
packs AS (SELECT pack_id, max(total_items) AS total_items, count(*) AS included, coalesce(sum(chars) FILTER (stop IS NULL OR position < stop), 0) AS chars_used, max(CASE WHEN position = stop THEN item_id END) AS over_id FROM included GROUP BY pack_id)
SELECT_RESULT
SELECT p.pack_id, p.total_items, included, chars_used, CAST(ceil(chars_used / 4.0) AS BIGINT) AS tokens_used, over_id IS NOT NULL AS budget_truncated,
 CASE WHEN over_id IS NOT NULL THEN 'budget-exhausted' WHEN p.total_items > included THEN 'item-limit' END AS omitted_reason,
 CASE WHEN over_id IS NOT NULL THEN p.total_items - included + 1 WHEN p.total_items > included THEN p.total_items - included ELSE 0 END AS omitted_items,
 coalesce(over_id, n.item_id) AS first_omitted_id
FROM packs p LEFT JOIN placed n ON n.pack_id = p.pack_id AND n.position = p.included + 1 AND over_id IS NULL""")
def _(f):
    return budget.budget_summary(ranked_items(f), 30000, 25)


@query("snippets", "doc_id i, line i, start_line i, stop_line i, lines a", f"""
WITH {SPLIT}, asked AS (SELECT DISTINCT doc_id, CAST(n_chars % 40 AS INT) AS line FROM f_docs UNION SELECT doc_id, 1 FROM f_docs)
SELECT_RESULT
SELECT s.doc_id, line, greatest(1, line - 2) AS start_line, least(len(ls), line + 2) AS stop_line, list_slice(ls, greatest(1, line - 2), least(len(ls), line + 2)) AS lines
FROM asked a JOIN split_docs s ON s.doc_id = a.doc_id WHERE line BETWEEN 1 AND len(ls)""")
def _(f):
    asked = f.sql("SELECT doc_id, CAST(n_chars % 40 AS INT) AS line FROM f_docs UNION SELECT doc_id, 1 FROM f_docs")
    return budget.snippets(asked, f.f_docs, 2, key="doc_id")


@query("source_slices", "target_id s, start_line i, line_count i, text s, truncated b, status s", f"""
WITH {SPLIT}, d AS (SELECT doc_id, ls, CAST(doc_id % 5 + 1 AS INT) AS lo, CAST(doc_id % 5 + 1 + doc_id % 23 AS INT) AS hi FROM split_docs),
cut AS (SELECT doc_id, lo, hi, hi - lo + 1 AS cnt, list_slice(ls, lo, lo + least(hi - lo + 1, 12) - 1) AS l FROM d),
pos AS (SELECT doc_id, lo, cnt, l, i, l[i] AS line, sum(length(l[i])) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM cut) x),
firsts AS (SELECT *, min(CASE WHEN run > 1600 THEN i END) OVER (PARTITION BY doc_id) AS stop FROM pos),
shown AS (SELECT doc_id, max(stop) AS stop, list(CASE WHEN i = stop THEN substr(line, 1, CAST(1600 - (run - length(line)) AS BIGINT)) ELSE line END ORDER BY i) FILTER ((stop IS NULL OR i <= stop) AND NOT coalesce(i = stop AND 1600 - (run - length(line)) <= 0, false)) AS outl FROM firsts GROUP BY doc_id)
SELECT_RESULT
SELECT concat('d', CAST(c.doc_id AS VARCHAR)) AS target_id, lo AS start_line, coalesce(len(outl), 0) AS line_count, coalesce(array_to_string(outl, chr(10)), '') AS text, cnt > 12 OR stop IS NOT NULL AS truncated, 'ok' AS status
FROM cut c LEFT JOIN shown s ON s.doc_id = c.doc_id
UNION ALL SELECT concat('x', CAST(s_suppkey AS VARCHAR)), NULL, NULL, NULL, NULL, 'source-location-not-found' FROM supplier""")
def _(f):
    decls = f.sql(
        "SELECT doc_key AS symbol_id, doc_key AS path, CAST(doc_id % 5 + 1 AS INT) AS line, CAST(doc_id % 5 + 1 + doc_id % 23 AS INT) AS end_line, false AS is_metadata FROM f_docs"
    )
    asked = f.sql("SELECT doc_key AS target_id, doc_key AS symbol_id FROM f_docs UNION ALL SELECT concat('x', CAST(s_suppkey AS STRING)), s_name FROM supplier")
    docs = f.f_docs.select(F.col("doc_key").alias("path"), "text")
    found = budget.source_slices(asked, decls, docs, 12, 400)
    return found.withColumn("line_count", F.array_size("lines")).withColumn("text", F.array_join("lines", "\n"))


@query("trim_profile", "path s, line i, target_symbol_id s", """
SELECT path, line, target_symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, column_no, target_symbol_id, end_column, project) AS rn FROM f_refs) x WHERE rn <= 10""")
def _(f):
    return core.trim_profile(
        f.f_refs.withColumn("snippet", F.lit("")), "compact", ["line", "column", "target_symbol_id", "end_column", "project"], group=["path"],
        snippet_columns=["snippet"],
    )


@query("write_and_read_results", "doc_key s, rel_path s", "SELECT doc_key, CASE WHEN starts_with(path, '/work/fr/') THEN substr(path, 10) END AS rel_path FROM f_docs")
def _(f):
    df = documents.document_index(f.f_docs.drop("text"), "/work/fr").select("doc_key", "rel_path")
    cut_lineage(df.limit(1))  # makes sure a checkpoint folder is set; results go next to it
    folder = f"{f.spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    documents.write_results(df, folder)
    return f.spark.read.schema("doc_key string, rel_path string").json(folder)
