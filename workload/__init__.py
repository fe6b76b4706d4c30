"""Registered queries on the shared test tables, each beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(column: Column | str, name: str | None = None) -> Column:
    """A double rounded to nine places under its own or a given name."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), 9).alias(name or column)


def load_all() -> None:
    """Import the modules that register queries."""
    from workload import api, drift, ingest, metrics, monitoring, profiles, registry, training  # noqa: F401
