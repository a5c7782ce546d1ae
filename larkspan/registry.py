"""Where every query registers itself, together with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from larkspan.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def shipped(fn: Query) -> Query:
    """``fn``, with the package on the workers before it runs."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``.

    ``sql`` is an equivalent statement over the same tables; jobs without one are
    checked in tests against brute force on a small fixture.
    """

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query key: {key}")
        QUERIES[key] = shipped(fn)
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register
