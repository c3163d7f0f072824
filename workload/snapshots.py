"""API snapshot comparison, edit guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspan.functions import names
from factspan.operators import filters, impact, snapshots

from .registry import query


def _api(df):
    marks = F.when(F.col("attribute_count") > 0, F.transform(F.sequence(F.lit(1), "attribute_count"), lambda i: i.cast("string"))).otherwise(
        F.array().cast("array<string>")
    )
    params = F.when(F.col("param_count") > 0, F.sequence(F.lit(1), "param_count")).otherwise(F.array().cast("array<int>"))
    return (
        df.withColumn("modifiers", F.array("modifier"))
        .withColumn("parameters", params)
        .withColumn("generic_constraints", F.array("facet"))
        .withColumn("nullable_annotations", F.array("kind"))
        .withColumn("default_values", F.array(F.when(F.col("facet") == "X", "x").otherwise("y")))
        .withColumn("attributes", marks)
        .drop("modifier", "facet", "attribute_count", "param_count")
    )


def sides(f):
    return snapshots.api_snapshot(_api(f.f_base)), snapshots.api_snapshot(_api(f.f_head))


COMPARE = """
b AS (SELECT * FROM f_base), h AS (SELECT * FROM f_head),
facets AS (
  SELECT 'generic-constraints-changed' AS code, h.*, b.line AS bl FROM b JOIN h ON h.doc_id = b.doc_id WHERE b.facet <> h.facet
  UNION ALL SELECT 'nullable-annotation-changed', h.*, b.line FROM b JOIN h ON h.doc_id = b.doc_id WHERE b.kind <> h.kind
  UNION ALL SELECT 'default-parameter-changed', h.*, b.line FROM b JOIN h ON h.doc_id = b.doc_id WHERE (b.facet = 'X') <> (h.facet = 'X')
  UNION ALL SELECT 'abstract-virtual-sealed-changed', h.*, b.line FROM b JOIN h ON h.doc_id = b.doc_id WHERE (b.modifier = 'abstract') <> (h.modifier = 'abstract')
  UNION ALL SELECT 'enum-member-value-changed', h.*, b.line FROM b JOIN h ON h.doc_id = b.doc_id WHERE b.kind = 'EnumMember' AND b.signature <> h.signature
  UNION ALL SELECT CASE WHEN b.attribute_count < h.attribute_count THEN 'attribute-added' ELSE 'attribute-removed' END, h.*, b.line FROM b JOIN h ON h.doc_id = b.doc_id WHERE b.attribute_count <> h.attribute_count),
bo AS (SELECT *, row_number() OVER (PARTITION BY kind, container, name, param_count ORDER BY doc_id) AS place FROM b WHERE doc_id NOT IN (SELECT doc_id FROM h)),
ho AS (SELECT *, row_number() OVER (PARTITION BY kind, container, name, param_count ORDER BY doc_id) AS place FROM h WHERE doc_id NOT IN (SELECT doc_id FROM b)),
pairs AS (SELECT ho.*, bo.doc_id AS base_id, bo.line AS bl FROM bo JOIN ho ON ho.kind = bo.kind AND ho.container = bo.container AND ho.name = bo.name AND ho.param_count = bo.param_count AND ho.place = bo.place),
ifaces AS (SELECT DISTINCT name FROM h WHERE kind = 'NamedType' AND contains(signature, 'interface')),
changes AS (
  SELECT code, 'change' AS change, doc_id, bl, line AS hl FROM facets
  UNION ALL SELECT 'public-signature-changed', 'change', doc_id, bl, line FROM pairs
  UNION ALL SELECT CASE kind WHEN 'NamedType' THEN 'public-type-removed' WHEN 'EnumMember' THEN 'enum-member-removed' ELSE 'public-member-removed' END, 'removal', doc_id, line, NULL FROM bo WHERE doc_id NOT IN (SELECT base_id FROM pairs)
  UNION ALL SELECT CASE WHEN kind <> 'NamedType' AND list_extract(string_split(container, '.'), -1) IN (SELECT name FROM ifaces) THEN 'interface-member-added' ELSE CASE kind WHEN 'NamedType' THEN 'public-type-added' WHEN 'EnumMember' THEN 'enum-member-added' ELSE 'public-member-added' END END,
    'addition', doc_id, NULL, line FROM ho WHERE doc_id NOT IN (SELECT doc_id FROM pairs)),
risked AS (SELECT *,
  CASE WHEN change = 'removal' OR code IN ('generic-constraints-changed', 'abstract-virtual-sealed-changed', 'public-signature-changed', 'interface-member-added') THEN 'breaking' WHEN change = 'addition' THEN 'compatible' ELSE 'risk' END AS source_risk,
  CASE WHEN change = 'removal' OR code IN ('enum-member-value-changed', 'public-signature-changed', 'interface-member-added') THEN 'breaking' WHEN change = 'addition' OR code = 'nullable-annotation-changed' THEN 'compatible' ELSE 'risk' END AS binary_risk FROM changes)"""


@query("api_changes", "code s, change s, doc_id s, source_risk s, binary_risk s, base_line i, head_line i", f"""
WITH {COMPARE}
SELECT_RESULT
SELECT code, change, doc_id, source_risk, binary_risk, bl AS base_line, hl AS head_line FROM risked""")
def _(f):
    return snapshots.api_changes(*sides(f))


@query("api_matched_changes", "code s, doc_id s, source_risk s, binary_risk s, confidence s", f"""
WITH {COMPARE}
SELECT_RESULT
SELECT code, doc_id, source_risk, binary_risk, CASE WHEN code = 'enum-member-value-changed' THEN 'high' ELSE 'medium' END AS confidence FROM risked WHERE code IN (SELECT code FROM facets)""")
def _(f):
    return snapshots.diff_matched(*sides(f))


@query("api_signature_pairs", "doc_id s, base_id s, base_line i, head_line i", f"""
WITH {COMPARE}
SELECT_RESULT
SELECT doc_id, base_id, bl AS base_line, line AS head_line FROM pairs""")
def _(f):
    return snapshots.pair_signature_changes(*snapshots.unmatched(*sides(f)))


@query("api_removals_additions", "code s, change s, doc_id s, binary_risk s", f"""
WITH {COMPARE}
SELECT_RESULT
SELECT CASE kind WHEN 'NamedType' THEN 'public-type-removed' WHEN 'EnumMember' THEN 'enum-member-removed' ELSE 'public-member-removed' END AS code, 'removal' AS change, doc_id, 'breaking' AS binary_risk FROM bo
UNION ALL SELECT CASE WHEN kind <> 'NamedType' AND container IN (SELECT concat('C', n_nationkey) FROM nation) THEN 'interface-member-added' ELSE CASE kind WHEN 'NamedType' THEN 'public-type-added' WHEN 'EnumMember' THEN 'enum-member-added' ELSE 'public-member-added' END END,
 'addition', doc_id, CASE WHEN kind <> 'NamedType' AND container IN (SELECT concat('C', n_nationkey) FROM nation) THEN 'breaking' ELSE 'compatible' END FROM ho""")
def _(f):
    base, head = sides(f)
    base_only, head_only = snapshots.unmatched(base, head)
    types = f.sql("SELECT concat('C', CAST(n_nationkey AS STRING)) AS name, 'NamedType' AS kind, 'interface' AS signature FROM nation")
    return snapshots.removals_additions(base_only, head_only, types)


@query("api_diff_bounded", "position i, code s, doc_id s, total i, truncated b", f"""
WITH {COMPARE}, full_rows AS (SELECT r.*, CASE WHEN binary_risk = 'breaking' THEN 0 WHEN source_risk = 'breaking' THEN 1 WHEN source_risk = 'risk' OR binary_risk = 'risk' THEN 2 ELSE 3 END AS risk_order,
  coalesce(h.container, b.container) AS container, coalesce(h.name, b.name) AS name, coalesce(h.path, b.path) AS path, coalesce(h.line, b.line) AS line, coalesce(h.column_no, b.column_no) AS col FROM risked r LEFT JOIN h ON h.doc_id = r.doc_id LEFT JOIN b ON b.doc_id = r.doc_id),
placed AS (SELECT *, row_number() OVER (ORDER BY risk_order, code, container, name, path, line, col, doc_id) AS position, count(*) OVER () AS total FROM full_rows)
SELECT_RESULT
SELECT position, code, doc_id, total, total > 100 AS truncated FROM placed WHERE position <= 100""")
def _(f):
    return snapshots.api_diff(*sides(f), limit=100)


@query("api_diff_summary", "total_changes i, source_breaking i, binary_breaking i, additions i, removals i, signature_changes i", f"""
WITH {COMPARE}
SELECT_RESULT
SELECT count(*) AS total_changes, count(*) FILTER (source_risk = 'breaking') AS source_breaking, count(*) FILTER (binary_risk = 'breaking') AS binary_breaking,
 count(*) FILTER (change = 'addition') AS additions, count(*) FILTER (change = 'removal') AS removals, count(*) FILTER (code = 'public-signature-changed') AS signature_changes FROM risked""")
def _(f):
    return snapshots.api_diff_summary(snapshots.api_changes(*sides(f)))


@query("api_snapshot_bounded", "name s, position i, doc_id s, total i, truncated b", """
SELECT name, position, doc_id, total, total > 40 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS position, count(*) OVER (PARTITION BY name) AS total FROM f_base) x WHERE position <= 40""")
def _(f):
    return snapshots.api_snapshot(f.f_base, 40, ["name"])


@query("signature_functions", "symbol_id s, id s, defaults a, annotations a", """
SELECT symbol_id, concat(CASE kind WHEN 'NamedType' THEN 'T' WHEN 'Property' THEN 'P' ELSE 'M' END, ':', container, '.', name, CASE WHEN line % 2 = 0 THEN concat('(', namespace, ',int)') ELSE '' END) AS id,
 CASE WHEN line % 2 = 0 THEN [concat('b=', container)] ELSE [] END AS defaults, CASE WHEN column_no % 3 = 0 THEN ['annotated'] ELSE [] END AS annotations FROM f_decls""")
def _(f):
    params = F.when(
        F.col("line") % 2 == 0,
        F.array(
            F.struct(F.lit("a").alias("name"), F.col("namespace").alias("type"), F.lit(None).cast("string").alias("default_value")),
            F.struct(F.lit("b").alias("name"), F.lit("int").alias("type"), F.col("container").alias("default_value")),
        ),
    ).otherwise(F.array().cast("array<struct<name:string,type:string,default_value:string>>"))
    df = f.f_decls.withColumn("p", params)
    signature = F.when(F.col("column") % 3 == 0, F.concat("signature", F.lit("?"))).otherwise(F.col("signature"))
    return df.select(
        "symbol_id", names.doc_id("kind", "container", "name", F.transform("p", lambda x: x["type"])).alias("id"),
        names.default_values("p").alias("defaults"), names.nullable_annotations(signature).alias("annotations"),
    )


# Guards: the anchor is a base symbol, its change holds the head symbols of the same customer.
GUARD = """
anchors AS (SELECT doc_id AS anchor_id, container AS change_id, CASE WHEN line % 2 = 0 THEN doc_id END AS candidate_id, name, kind, container, path, modifier AS project FROM f_base),
changed AS (SELECT container AS change_id, doc_id AS symbol_id, name, kind, container, concat(path, CASE WHEN line % 4 = 0 THEN 'x' ELSE '' END) AS path, CASE WHEN line % 5 = 0 THEN NULL ELSE modifier END AS project, line FROM f_head),
states AS (SELECT a.anchor_id, a.change_id, a.candidate_id, c.symbol_id, c.path AS cp, c.line AS cl,
  CASE WHEN c.name IS NULL THEN 'mismatch-name:unknown' WHEN a.name = c.name THEN 'matched-name' ELSE 'mismatch-name' END AS s1,
  CASE WHEN a.kind = c.kind THEN 'matched-kind' ELSE 'mismatch-kind' END AS s2, CASE WHEN a.container = c.container THEN 'matched-container' ELSE 'mismatch-container' END AS s3,
  CASE WHEN a.path = c.path THEN 'matched-path' ELSE 'mismatch-path' END AS s4, CASE WHEN c.project IS NULL THEN 'mismatch-project:unknown' WHEN a.project = c.project THEN 'matched-project' ELSE 'mismatch-project' END AS s5
  FROM anchors a LEFT JOIN changed c ON c.change_id = a.change_id),
scored AS (SELECT *, CASE WHEN symbol_id IS NULL THEN 0 ELSE (CASE WHEN s1 = 'matched-name' THEN 35 ELSE 0 END + CASE WHEN s2 = 'matched-kind' THEN 20 ELSE 0 END + CASE WHEN s3 = 'matched-container' THEN 20 ELSE 0 END
  + CASE WHEN s4 = 'matched-path' THEN 15 ELSE 0 END + CASE WHEN s5 = 'matched-project' THEN 10 ELSE 0 END) / 100.0 END AS score FROM states)"""
ANCHORS = "SELECT doc_id AS anchor_id, container AS change_id, CASE WHEN line % 2 = 0 THEN doc_id END AS candidate_id, name, kind, container, path, modifier AS project FROM f_base"
CHANGED = (
    "SELECT container AS change_id, doc_id AS symbol_id, name, kind, container, concat(path, CASE WHEN line % 4 = 0 THEN 'x' ELSE '' END) AS path, "
    "CASE WHEN line % 5 = 0 THEN NULL ELSE modifier END AS project, line FROM f_head"
)


@query("match_scores", "anchor_id s, symbol_id s, score d", f"""
WITH {GUARD}, best AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, cp NULLS FIRST, cl, symbol_id) AS rn FROM scored)
SELECT_RESULT
SELECT anchor_id, symbol_id, score FROM best WHERE rn = 1""")
def _(f):
    return impact.match_score(f.sql(ANCHORS), f.sql(CHANGED))


@query("edit_guard", "anchor_id s, symbol_id s, best_score d, risk s, passed b, reason_codes a", f"""
WITH {GUARD}, best AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, cp NULLS FIRST, cl, symbol_id) AS rn, CASE WHEN score >= 0.75 THEN 'low' WHEN score >= 0.45 THEN 'medium' ELSE 'high' END AS risk FROM scored)
SELECT_RESULT
SELECT anchor_id, symbol_id, score AS best_score, risk, risk = 'low' AS passed, list_sort(list_distinct(list_filter([CASE WHEN symbol_id IS NULL THEN 'no-changed-symbols-found' END, CASE WHEN symbol_id IS NULL THEN 'no-anchor-match' END,
  CASE WHEN symbol_id IS NOT NULL THEN s1 END, CASE WHEN symbol_id IS NOT NULL THEN s2 END, CASE WHEN symbol_id IS NOT NULL THEN s3 END, CASE WHEN symbol_id IS NOT NULL THEN s4 END, CASE WHEN symbol_id IS NOT NULL THEN s5 END,
  CASE WHEN risk <> 'low' THEN CASE WHEN candidate_id IS NULL THEN 'anchor-has-no-candidate-id' ELSE 'anchor-risk-requires-review' END END], lambda x: x IS NOT NULL))) AS reason_codes FROM best WHERE rn = 1""")
def _(f):
    return impact.edit_guard(f.sql(ANCHORS), f.sql(CHANGED), fail_on="medium")


@query("read_anchor", "event_id i, name s, line i, confidence s, broken b", """
SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS name, CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS line,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'high' ELSE 'unknown' END AS confidence, event_id % 11 = 0 AS broken FROM events""")
def _(f):
    text = F.concat(
        F.lit('{"v":1,"anchor":{"name":"'), "event_type", F.lit('","line":'), F.get_json_object("props", "$.k"),
        F.when(F.col("event_id") % 3 == 0, ',"confidence":"high"').otherwise(""), F.when(F.col("event_id") % 11 == 0, "").otherwise("}}"),
    )
    anchor = impact.read_anchor(text)
    return f.events.select("event_id", anchor.alias("a")).select(
        "event_id", "a.name", "a.line", "a.confidence", F.col("a").isNull().alias("broken")
    )


@query("public_contract_changes", "symbol_id s, code s, confidence s, reason_codes a", """
SELECT symbol_id, 'changed-public-symbol' AS code, 'medium' AS confidence, ['current-public-symbol-changed', 'public-accessibility'] AS reason_codes FROM f_decls WHERE accessibility IN ('Public', 'Protected')""")
def _(f):
    return filters.public_contract_changes(f.f_decls)
