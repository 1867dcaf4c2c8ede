"""Named queries over the derived tables, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is what DuckDB runs on the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six digits, the precision results are compared at."""
    col = F.col(c) if isinstance(c, str) else c
    label = name or (c if isinstance(c, str) else None)
    out = F.round(col, 6)
    return out.alias(label) if label else out


def s6(expr: str, name: str) -> str:
    """The same for SQL text; adding zero turns -0.0 into 0.0."""
    return f"round({expr}, 6) + 0e0 AS {name}"
