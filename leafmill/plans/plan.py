"""Operators written as SQL over named tables, and how they are run on Spark or written out as one SQL statement."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


@dataclass(frozen=True)
class Plan:
    """An operator: Spark SQL over `inputs`, or a function of them (`run`), what it does, and DuckDB's SQL (over `oracle_inputs`) where that differs.

    `dealt` names driver tables and the column by which its query brings their rows together before views are made of them; see deal().
    """

    inputs: tuple[str, ...]
    doc: str
    sql: str = ""
    duckdb: str | None = None
    run: Callable[..., DataFrame] | None = None
    oracle_inputs: tuple[str, ...] | None = None
    dealt: tuple[tuple[str, str], ...] = ()

    def apply(self, **tables: DataFrame) -> DataFrame:
        """The operator's result over the given DataFrames, one for each input."""
        missing = set(self.inputs) - set(tables)
        if missing:
            raise ValueError(f"tables missing: {', '.join(sorted(missing))}")
        if self.run is not None:
            return self.run(**{t: tables[t] for t in self.inputs})
        spark = next(iter(tables.values())).sparkSession
        return run_sql(spark, self.sql, {t: tables[t] for t in self.inputs})


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Runs SQL that names DataFrames as {name}. Braces elsewhere are kept."""
    for name in tables:
        sql = re.sub(rf"\b(FROM|JOIN|from|join)(\s+){name}\b", rf"\1\2{{{name}}}", sql)
    return spark.sql(sql, **tables)


def run_together(sql: str, key: str, **tables: DataFrame) -> DataFrame:
    """As run_sql, over tables whose rows of a key are brought together first, so that windows and groups within a key move nothing more.

    The partitions are as many as spark.sql.shuffle.partitions says: by the bytes that move, Spark would merge them to a few, whose sorts are large.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return run_sql(spark, sql, {n: df.repartition(parts, key) for n, df in tables.items()})


def deal(df: DataFrame, key: str, rows: int = 2000) -> DataFrame:
    """A table whose rows of a key are together, in parts of about `rows` rows: what its rows are taken apart into is grouped in the same task, which then has little to sort however large the table is."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, math.ceil(df.count() / rows)), key)


def view(spark: SparkSession, sf_dir: str, name: str, dealt: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """A canonical view, or a driver table, of a folder."""
    if name not in VIEWS:
        df, keys = spark.read.parquet(f"{sf_dir}/{name}.parquet"), dict(dealt)
        return deal(df, keys[name]) if name in keys else df
    sql, reads = VIEWS[name]
    sql = sql if isinstance(sql, str) else sql["spark"]
    return run_sql(spark, sql, {t: view(spark, sf_dir, t, dealt) for t in reads})


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        if n in VIEWS and n not in seen:
            _needed(VIEWS[n][1], seen)
            seen.append(n)
    return seen


def oracle(plan: Plan) -> str:
    """The plan as one DuckDB statement over the driver's tables."""
    parts = []
    for n in _needed(plan.oracle_inputs or plan.inputs, []):
        sql = VIEWS[n][0]
        parts.append(f"{n} AS ({sql if isinstance(sql, str) else sql['duckdb']})")
    body = (plan.duckdb or plan.sql).strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ", ".join([*parts, body[len(start) :]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
