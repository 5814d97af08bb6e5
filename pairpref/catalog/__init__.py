"""Registered queries: a Spark function per operator and, where SQL can say the same, its equivalent."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from pairpref.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EQUIVALENT_SQL: dict[str, str] = {}
MODULES = ("scalars", "populations", "descriptive", "estimation", "uncertainty", "evidence", "storage")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            EQUIVALENT_SQL[name] = sql
        return run

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"pairpref.catalog.{module}")
