"""Unified-diff text to files and hunks.

A diff is cut into files, and a file into header and hunk headers, inside the row that holds it: parsing needs no
shuffle and no window. File headers are read only up to the first hunk, so changed lines that look like headers
are not taken for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import normalize_path
from ..operators.core import dedupe_first

HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _files(diff_text: DataFrame) -> DataFrame:
    text = F.regexp_replace("text", "\r\n|\r", "\n")
    parts = F.split(text, r"(?m)^(?=diff --git )")
    chunks = F.filter(parts, lambda p: p.startswith("diff --git "))
    keys = [c for c in diff_text.columns if c != "text"]
    return diff_text.select(*keys, F.posexplode(chunks).alias("file_no", "chunk")).withColumn(
        "header", F.element_at(F.split("chunk", r"(?m)^(?=@@ -)", 2), 1)
    )


def _last(pattern: str) -> Column:
    """Last match of a one-line pattern in the header; null when there is none."""
    found = F.regexp_extract_all("header", F.lit(f"(?m){pattern}"), 1)
    return F.try_element_at(found, F.lit(-1))


def _marker(sign: str) -> Column:
    raw = _last(rf"^{sign}{sign}{sign} ([^\t\n]*)".replace("+", r"\+"))
    return F.trim(raw)


def _facts(diff_text: DataFrame) -> DataFrame:
    minus, plus = _marker("-"), _marker("+")
    renamed_from = normalize_path(_last(r"^rename from (.*)$"))
    renamed_to = normalize_path(_last(r"^rename to (.*)$"))
    old = F.coalesce(renamed_from, F.when(minus != "/dev/null", normalize_path(minus)))
    mode = _last(r"^(new file mode|deleted file mode|rename from|rename to) ")
    stated = F.when(mode == "new file mode", "added").when(mode == "deleted file mode", "deleted").when(mode.isNotNull(), "renamed")
    gone = F.coalesce(plus == "/dev/null", F.lit(False))
    path = F.when(gone | plus.isNull(), F.coalesce(renamed_to, old)).otherwise(normalize_path(plus))
    kept_old = F.when(F.col("__old") != F.col("path"), F.col("__old"))
    status = F.when(gone, "deleted").otherwise(
        F.coalesce(stated, F.when(F.col("old_path").isNull(), "modified").otherwise("renamed"))
    )
    return (
        _files(diff_text)
        .withColumn("__old", old)
        .withColumn("path", path)
        .filter(F.col("path").isNotNull())
        .withColumn("old_path", kept_old)
        .withColumn("status", status)
    )


def parse_diff_files(diff_text: DataFrame) -> DataFrame:
    """(keys, file_no, path, old_path, status) of each file of each diff."""
    keys = [c for c in diff_text.columns if c != "text"]
    return _facts(diff_text).select(*keys, "file_no", "path", "old_path", "status")


def parse_diff_hunks(diff_text: DataFrame) -> DataFrame:
    """(keys, file_no, path, hunk_no, starts and counts); a missing count is 1."""
    keys = [c for c in diff_text.columns if c != "text"]
    headers = F.regexp_extract_all("chunk", F.lit(HUNK), 0)
    rows = _facts(diff_text).select(*keys, "file_no", "path", F.posexplode(headers).alias("hunk_no", "h"))

    def group(n: int) -> Column:
        value = F.regexp_extract("h", HUNK, n)
        return F.when(value == "", F.lit("1")).otherwise(value).cast("int")

    return rows.select(
        *keys, "file_no", "path", "hunk_no",
        group(1).alias("old_start"), group(2).alias("old_count"), group(3).alias("new_start"), group(4).alias("new_count"),
    )


def with_untracked(diff_files: DataFrame, hunks: DataFrame, untracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed files and hunks with untracked files, each as one added whole-file hunk; the first per path wins.

    ``untracked(change_id, path, line_count)``.
    """
    new_files = untracked.select(
        "change_id", F.lit(-1).alias("file_no"), "path", F.lit(None).cast("string").alias("old_path"), F.lit("added").alias("status")
    )
    both = diff_files.withColumn("__side", F.lit(0)).unionByName(new_files.withColumn("__side", F.lit(1)))
    files = dedupe_first(both, ["change_id", "path"], ["__side", "file_no", "status"])
    fresh = files.filter(F.col("__side") == 1).select("change_id", "path")
    whole = untracked.join(fresh, ["change_id", "path"], "left_semi").select(
        "change_id", F.lit(-1).alias("file_no"), "path", F.lit(0).alias("hunk_no"),
        F.lit(0).alias("old_start"), F.lit(0).alias("old_count"), F.lit(1).alias("new_start"),
        F.col("line_count").cast("int").alias("new_count"),
    )
    return files.drop("__side"), hunks.unionByName(whole.select(*hunks.columns))
