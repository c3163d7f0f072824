"""What the runtime settings let Spark broadcast."""

from pyspark.sql import functions as F

from factspan.operators import spans


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rows_exploded_from_a_small_file_are_not_planned_as_broadcast(spark, tmp_path):
    """Forty thousand like rows are a small file, but 800,000 changed lines with nine cells each: the file's size says nothing of the sides."""
    seen = spark.range(40000).select(F.concat(F.lit("p"), F.col("id") % 500).alias("path"), (F.col("id") % 900 + 1).cast("int").alias("line"))
    seen.write.parquet(f"{tmp_path}/seen")
    seen = spark.read.parquet(f"{tmp_path}/seen")
    hunks = seen.select(F.lit("c").alias("change_id"), "path", F.col("line").alias("new_start"), F.lit(20).alias("new_count"))
    decls = seen.select(F.concat("path", F.lit("#"), "line").alias("symbol_id"), "path", F.lit("Method").alias("kind"), "line", (F.col("line") + 30).alias("end_line"))
    plan = _plan(spans.changed_declarations(hunks, decls))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
