"""Documents, declarations and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import file_name, in_build_output, is_generated_path, is_source_path, relative_path
from ..functions.ranks import reasons
from ..operators.core import dedupe_first, fingerprint, join_null_safe


def document_index(docs: DataFrame, root: Column | str) -> DataFrame:
    """Documents with root-relative path (null outside the root) and base name."""
    root = F.lit(root) if isinstance(root, str) else root
    return docs.withColumn("rel_path", relative_path("path", root)).withColumn("file_name", file_name("path"))


def document_lookup(paths: DataFrame, index: DataFrame) -> DataFrame:
    """Requested paths by full path first, else by relative path; the first by (path, project, doc_id).

    ``paths(request_id, request_path, request_project?)``: a project restricts the choice.
    """
    # Many requests may ask one question and many documents may share a path: neither multiplies the other.
    question = ["request_path", "request_project"]
    asked = paths.select(*question).distinct()

    def find(key: str, rank: int) -> DataFrame:
        first = dedupe_first(index.select(F.col(key).alias("__key"), "path", "project", "doc_id"), ["__key", "project"], ["path", "doc_id"])
        hits = asked.join(first, F.col("request_path") == F.col("__key"))
        same = F.col("request_project").isNull() | (F.col("request_project") == F.col("project"))
        return hits.filter(same).select(*question, "path", "project", "doc_id", F.lit(rank).alias("__rank"))

    hits = find("path", 0).unionByName(find("rel_path", 1))
    order = ["__rank", "path", "project", "doc_id"]
    answers = join_null_safe(paths.select("request_id", *question), dedupe_first(hits, question, order), question)
    best = dedupe_first(answers, ["request_id"], order).drop("__rank", *question)
    return paths.select("request_id", "request_path").join(best, "request_id", "left")


def document_stats(docs: DataFrame, keys=("repo",)) -> DataFrame:
    """Per workspace: documents, distinct paths, distinct file names, size estimate.

    Distinct values are grouped away first, so a heavy workspace is spread over all its paths.
    """
    named = docs.withColumn("file_name", file_name("path"))
    per_path = named.groupBy(*keys, "file_name", "path").agg(
        F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")
    )
    per_name = per_path.groupBy(*keys, "file_name").agg(
        F.sum("n").alias("n"), F.count("*").alias("paths"), F.sum("chars").alias("chars")
    )
    return per_name.groupBy(*keys).agg(
        F.sum("n").alias("documents"),
        F.sum("paths").alias("distinct_paths"),
        F.count("*").alias("distinct_names"),
        (F.sum("n") * 128 + F.sum("chars") * 2).alias("size_estimate"),
    )


def declaration_index(decls: DataFrame) -> DataFrame:
    """Declarations with a non-blank name and a generated flag."""
    return decls.filter(F.trim("name") != "").withColumn("is_generated", is_generated_path("path"))


def snapshot_files(files: DataFrame, ref: str, exclude_generated: bool = True) -> DataFrame:
    """Source files of one snapshot without build outputs and, if asked, generated files."""
    kept = files.filter((F.col("ref") == ref) & is_source_path("path") & ~in_build_output("path"))
    return kept.filter(~is_generated_path("path")) if exclude_generated else kept


SCHEMA_VERSION = 1


def manifest(docs: DataFrame) -> DataFrame:
    """Tracked files: length, modification time, digest."""
    return docs.select(
        "repo", "path", F.length("text").cast("long").alias("length"), "modified_at", F.sha2("text", 256).alias("sha256")
    )


def workspace_fingerprints(docs: DataFrame) -> DataFrame:
    """Digest of each workspace's name and its tracked files (path, length, digest) in the order of their paths."""
    return fingerprint(manifest(docs), ["repo"], ["path", "length", "sha256"], order=["path"], head=["repo"])


def write_manifest(docs: DataFrame, folder: str) -> None:
    """Manifest partitioned by workspace, and one fingerprint row per workspace."""
    manifest(docs).write.mode("overwrite").partitionBy("repo").parquet(f"{folder}/files")
    workspace_fingerprints(docs).withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").parquet(
        f"{folder}/workspaces"
    )


def manifest_status(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Per workspace: fresh, stale with reasons, or missing. Both sides (repo, schema_version, path, fingerprint)."""
    old = cached.select("repo", *[F.col(c).alias(f"__{c}") for c in ("schema_version", "path", "fingerprint")])
    joined = current.join(old, "repo", "left")
    stale = reasons(
        (F.col("schema_version") != F.col("__schema_version"), "schema-changed"),
        (~F.col("path").eqNullSafe(F.col("__path")), "path-changed"),
        (F.col("fingerprint") != F.col("__fingerprint"), "fingerprint-changed"),
    )
    missing = F.col("__fingerprint").isNull()
    status = F.when(missing, "missing").when(F.size(stale) > 0, "stale").otherwise("fresh")
    none = F.array().cast("array<string>")
    return joined.select("repo", status.alias("status"), F.when(missing, none).otherwise(stale).alias("stale_reasons"))


def write_results(df: DataFrame, folder: str, keep_nulls: bool = False) -> None:
    """Result rows as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(folder)
