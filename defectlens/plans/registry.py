"""Registry of named queries with their check statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship_package
from .sql import compose
from .views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the views; ``sql`` gives the same rows in another engine."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = compose(sql)
        return fn

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:

    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Views(spark, sf_dir))

        return run

    return {name: bind(fn) for name, fn in QUERIES.items()}


def r(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded column under its own (or a given) name."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, digits).alias(name or column)


def big(column: str, name: str | None = None) -> Column:
    return F.col(column).cast("bigint").alias(name or column)
