"""Every query that has an SQL twin gives the same rows; entry() runs; keys are well formed."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["r_name", "n_name", "order_year", "revenue", "n_lines"]
    assert df.count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, key):
    verdict, detail, _ = compare(spark, sf_dir, QUERIES[key], ORACLE[key], duck)
    assert verdict in ("ok", "NEAR"), f"{verdict}: {detail}"
