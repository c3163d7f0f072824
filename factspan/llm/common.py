"""Tables, row keys and shared intermediate results of the operators in this folder."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

# Rows and bytes of one Arrow batch: bounds a Python worker's memory whatever the texts' lengths.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on; Python workers find this package where the driver has it."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *known]))
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_table(df: DataFrame) -> DataFrame:
    """Write a result as Parquet below the folder in ``spark.checkpoint.dir`` and read it back: its lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(df.sparkSession.range(0))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, row key ``k`` and ``text``. Equal rows have equal keys; rows of one id with different texts do not."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text")


def same_row(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on (doc_id, k), where a missing id equals a missing id; ``right`` has one row for each."""
    renamed = right.withColumnRenamed("doc_id", "__doc").withColumnRenamed("k", "__k")
    on = left["doc_id"].eqNullSafe(renamed["__doc"]) & (left["k"] == renamed["__k"])
    return left.join(renamed, on, how).drop("__doc", "__k")


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def bucket_rank(df: DataFrame, keys: list[str], shuffle: Column, order: list, name: str, rows: int, per_bucket: int = 20_000) -> DataFrame:
    """0-based rank of every row within ``keys`` in the order of ``shuffle``, a long that is spread evenly over 0..2^60, then ``order``.

    Rows are ranked inside buckets of the shuffled range, and a bucket's offset comes from a table of bucket counts, so one key
    with most of the rows is spread over as many buckets as its size asks for. ``rows`` is the number of rows of ``df``,
    which is evaluated twice.
    """
    from pyspark.sql import Window

    width = (1 << 60) // max(1, -(-rows // per_bucket)) + 1
    placed = df.withColumn("__shuffle", shuffle).withColumn("__bucket", F.expr(f"__shuffle div {width}L"))
    counts = placed.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__shuffle", *order)
    ranked = placed.withColumn("__inside", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*keys, "__bucket"]).withColumn(name, F.col("__offset") + F.col("__inside")).drop("__bucket", "__inside", "__offset", "__shuffle")


def spread(*parts: Column) -> Column:
    """An even 60-bit hash of some columns that plain SQL can compute too."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

