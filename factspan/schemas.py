"""Schemas of the fact tables, and the check made at an operator's door."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOC = "path string, line int, column int, end_line int, end_column int"
_PARAMS = "array<struct<name:string,type:string,ordinal:int,ref_kind:string,is_optional:boolean,default_value:string>>"

DDL = {
    "documents": "repo string, project string, doc_id string, path string, text string",
    "declarations": (
        "symbol_id string, doc_id string, name string, kind string, container string, fqn string, namespace string, "
        "accessibility string, modifiers array<string>, attributes array<string>, signature string, project string, "
        f"target_framework string, {_LOC}"
    ),
    "references": f"target_symbol_id string, usage_kind string, project string, project_kind string, {_LOC}",
    "call_edges": f"caller_id string, callee_id string, {_LOC}",
    "type_edges": "child_id string, parent_id string, edge_kind string",
    "diagnostics": f"project string, severity string, id string, message string, {_LOC}",
    "diff_text": "change_id string, text string",
    "diff_files": "change_id string, file_no int, path string, old_path string, status string",
    "diff_hunks": (
        "change_id string, file_no int, path string, hunk_no int, old_start int, old_count int, new_start int, new_count int"
    ),
    "api_symbols": (
        "doc_id string, name string, kind string, container string, signature string, modifiers array<string>, "
        f"parameters {_PARAMS}, generic_constraints array<string>, nullable_annotations array<string>, "
        "default_values array<string>, attributes array<string>, path string, line int, column int"
    ),
    "project_files": "repo string, path string, xml string",
    "targets": (
        "target_id string, query string, match string, case_sensitive boolean, assume_kinds array<string>"
    ),
    "rules": "id string, kind string, from_pattern string, disallow array<string>",
    "context_items": f"pack_id string, item_id string, kind string, reason_codes array<string>, lines array<string>, {_LOC}",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def require(df: DataFrame, columns, where: str) -> DataFrame:
    """Fail early, and plainly, when an input lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: missing columns {missing}")
    return df
