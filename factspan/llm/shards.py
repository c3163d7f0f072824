"""Proportional stratified interleaving into shards with Spark SQL functions only; the law is ``rows``.

Rows of each source are ranked in a seeded shuffled order. A row's fractional rank is (rank + u) / rows of its source, where u is
a seeded number in [0, 1) of the source, so that small sources spread evenly too. All rows stand in the order of their
fractional ranks, and the order is cut into shards whose row counts differ by one at most: every shard has every source in
proportion.

A null source is a source of its own; a null text has no bytes. Repeated rows take places of their own.
Equal texts are not kept together: under this law a group may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import bucket_rank, settle, shared_table, spread

SEED = "interleave-1"


def interleave(docs: DataFrame, shards: int = 8, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (place in the shard), one row per row of ``docs``."""
    settle(docs.sparkSession)
    rows = docs.count()
    stratum = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", "source", stratum.alias("stratum"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    ranked = bucket_rank(narrow, ["stratum"], spread(F.lit(seed), F.col("doc_id").cast("string")), ["doc_id", "size", "text_crc32"], "rank", rows)
    totals = docs.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("total"))
    start = spread(F.lit(seed), F.col("stratum")) / F.lit(float(1 << 60))
    part = (F.col("rank") + start) / F.col("total")
    # The order key is a whole number of the width that bucket_rank spreads over.
    key = F.least(F.floor(part * F.lit(float(1 << 52))).cast("long"), F.lit((1 << 52) - 1)) * F.lit(1 << 8)
    placed = shared_table(ranked.join(totals, "stratum").withColumn("key", key).drop("total"))
    ordered = bucket_rank(placed, [], F.col("key"), ["stratum", "rank"], "place", rows)
    shard = F.expr(f"(place * {shards}) div {max(1, rows)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return ordered.withColumn("shard", shard).withColumn("slot", F.col("place") - first).select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
