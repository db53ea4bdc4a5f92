"""Collects queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` as ``name``."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, because sums run in another order in another engine."""
    return df.withColumns({name: F.round(name, digits) for name, kind in df.dtypes if kind == "double"})


def rounds(*names: str, digits: int = 6) -> str:
    """The same rounding as a SQL select list."""
    return ", ".join(f"round({name}, {digits}) + 0.0 AS {name}" for name in names)
