"""Named queries with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def day_text(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def time_text(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def big(c, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint").alias(name or c)
