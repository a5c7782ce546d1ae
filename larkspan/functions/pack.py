"""A pack is a list of ``(column name, Spark expression, SQL expression)`` over one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from larkspan.registry import query

Entry = tuple[str, Callable[[], Column], str]


def register(key: str, doc: str, source: Callable[[SparkSession, str], DataFrame], sql_source: str, entries: Sequence[Entry]) -> None:
    """Register one query that selects every entry, and the SQL that does the same."""
    sql = "select " + ",\n  ".join(f"{e} as {n}" for n, _, e in entries) + f"\nfrom {sql_source}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return source(spark, d).select(*[make().alias(n) for n, make, _ in entries])

    run.__doc__ = doc
    query(key, sql)(run)
