"""Queries of the operators in this folder over the whole given tables, with plain-SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, language_id, lattice, lexical, ngram_join, packing, quality, resampling, secret_scan, shards, substrings, suffix_dedup, toxicity
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _sha(text):
    return F.sha2(text.cast("binary"), 256)


@_query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        _sha(F.array_join("items", ",")).alias("items_sha256"), "contaminated",
    )


ORACLES["op1_benchmark_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0) AS x),
lengths AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n) AS x),
hits AS (SELECT d.doc_id, d.n, d.s, i.item_id FROM doc_windows d JOIN windows i ON d.win = i.win AND d.n = i.n),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits) AS y) AS z GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) AS y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


ORACLES["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM docs WHERE len(w) > 0) AS x),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * c >= 75 * (sx.n + sy.n - c)),
ends AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(src, dst) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.src, b.y FROM reach r JOIN ends b ON r.dst = b.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT src, min(dst) AS component_id FROM reach GROUP BY src) AS r ON r.src = d.doc_id
"""


@_query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.deduplicate(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


ORACLES["op4_substring_dedup"] = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM docs WHERE len(w) >= 50) AS x),
firsts AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN firsts USING (g) WHERE doc_id > least) AS y),
words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT a.doc_id, string_agg(a.w[a.p], ' ' ORDER BY a.p) AS kept FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p
  WHERE g.p IS NULL GROUP BY a.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
"""


@_query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secrets(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", _sha(F.col("base")).alias("base_sha256"), "spans", "n_markov")


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.classify(docs, toxicity.fitted(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", "p_junk", F.col("p_toxic").alias("score"), F.col("flagged").cast("int").alias("predicted"), F.col("flagged").alias("rejected"))


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@_query
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(read(spark, sf_dir, "embeddings"))


def _fold(of: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(_fold(4) != 2))
    held = F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out")
    return language_id.identify(docs, model).select("doc_id", held, "lang_pred", "score")


@_query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fitted(docs, read(spark, sf_dir, "labels").filter(_fold(5) != 0))
    held = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return quality.scored(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.interleave(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@_query
def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


ORACLES["op11_ranked_lexical_search"] = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
wanted AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) AS x),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) AS d, totals),
parts AS (
  SELECT item_id, tf.doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))) AS part
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN sizes ON sizes.doc_id = tf.doc_id, totals),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@_query
def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_suffix_array_dedup"] = r"""
WITH docs AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
blocks AS (
  SELECT doc_id, b, h[1024 * b + 1:1024 * b + 1822] AS part
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1024 + 1)) AS b FROM docs) AS x),
win AS (
  SELECT doc_id, 512 * b + s AS s, md5(part[2 * s + 1:2 * s + 800]) AS g
  FROM (SELECT doc_id, b, part, unnest(range(0, least(512, length(part) // 2 - 399))) AS s FROM blocks WHERE length(part) >= 800) AS x),
many AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
starts AS (SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS run FROM win SEMI JOIN many USING (g)),
runs AS (SELECT doc_id, min(s) AS lo, max(s) + 400 AS hi FROM starts GROUP BY doc_id, run),
marked AS (SELECT doc_id, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM runs),
numbered AS (SELECT doc_id, lo, hi, sum(fresh) OVER (PARTITION BY doc_id ORDER BY lo) AS span FROM marked),
spans AS (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM spans
  UNION ALL SELECT doc_id, max(hi), 1000000000 FROM spans GROUP BY doc_id),
counts AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(h[2 * lo + 1:2 * hi], '' ORDER BY lo) AS kept FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM docs d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), most=1)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_importance_resampling"] = r"""
WITH table_of AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS c FROM (SELECT unnest(range(256)) AS b) AS bytes) AS steps),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM docs),
tw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM tw) AS u),
coded AS (
  SELECT word, list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST(('0x' || substr(h, i, 2)) AS BIGINT))) AS bytes FROM vocabulary),
hashed AS (
  SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM coded, table_of),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw) AS all_s, (SELECT count(*) FROM tw) AS all_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) AS b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
weights AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs d LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank FROM scored s LEFT JOIN ranked r USING (doc_id)
"""


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
