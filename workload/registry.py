"""Registration of queries with their result columns and SQL counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factspan.session import tune

from .bindings import TABLES, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
_SQL = {"s": "VARCHAR", "i": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}


class Facts:
    """The given tables and the fact views over them, as DataFrames, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._open: set[str] = set()

    def _register(self, text: str) -> None:
        """Read the tables a statement names, once."""
        for name in TABLES:
            if name not in self._open and re.search(rf"\b{name}\b", text):
                self._open.add(name)
                self.spark.read.parquet(f"{self.folder}/{name}.parquet").createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            self._register(name)
            return self.spark.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        """A SQL statement over tables and fact views; ``column_no`` becomes ``column``, a word SQL reserves."""
        statement = with_views(text)
        self._register(statement)
        df = self.spark.sql(statement)
        return df.withColumnRenamed("column_no", "column")


def with_views(text: str) -> str:
    """Prefix a statement with the fact views it names, in dependency order."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", body):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(text)
    if not needed:
        return text
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    body = text.strip()
    for word in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(word):
            return f"{word} {views},\n{body[len(word):]}"
    return f"WITH {views}\n{body}"


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in spec.split(",")]


def query(name: str, columns: str, sql: str | None = None):
    """Register a function of (facts) with its columns: s text, i integer, d double, b boolean, a list of texts."""

    def register(build):
        columns_ = _columns(columns)

        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = build(Facts(tune(spark), folder))
            picked = []
            for c, t in columns_:
                expr = F.array_join(c, "|") if t == "a" else F.col(c).cast(_SPARK[t])
                picked.append(expr.alias(c))
            return df.select(*picked)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            outer = ", ".join(
                f"array_to_string(\"{c}\", '|') AS \"{c}\"" if t == "a" else f'CAST("{c}" AS {_SQL[t]}) AS "{c}"' for c, t in columns_
            )
            ORACLES[name] = with_views(_wrap(sql, outer))
        return build

    return register


def _wrap(sql: str, outer: str) -> str:
    body = sql.strip().rstrip(";")
    if body.upper().startswith("WITH"):
        # Keep the statement's own WITH list in front; its last SELECT becomes the 'result' entry.
        head, tail = body.rsplit("\nSELECT_RESULT\n", 1)
        return f"{head},\nresult AS ({tail})\nSELECT {outer} FROM result"
    return f"SELECT {outer} FROM ({body}) result"
