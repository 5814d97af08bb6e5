"""Registered queries of this subpackage: a Spark function each and, where SQL can say the same, its equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairpref.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EQUIVALENT_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
        if sql is not None:
            EQUIVALENT_SQL[name] = sql
        return function

    return register


def free_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, with underscores until no column has that name (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
