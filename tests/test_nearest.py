"""Largest inner products against brute force: blocks and chunks of few rows, ties, odd vectors, and how much is visited."""

from __future__ import annotations

import numpy as np
import pytest

from larkspan.plans.nearest import top_inner_products

USERS, ITEMS = "user bigint, f array<double>", "item bigint, f array<double>"


def vectors(n, seed, skewed):
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, (n, 4)).astype(float)  # whole numbers: equal scores are exactly equal
    return v * (1 + np.floor(60 / (1 + np.arange(n))))[:, None] if skewed else v


@pytest.mark.parametrize("k, block, chunk, skewed", [(1, 4, 7, True), (3, 4, 100, False), (5, 7, 10, True), (3, 1000, 1000, False)])
def test_equal_to_all_products(spark, k, block, chunk, skewed):
    u, v = vectors(40, 1, False), vectors(50, 2, skewed)
    users = [(i, x.tolist()) for i, x in enumerate(u)]
    items = [(100 - i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0])]
    got = top_inner_products(spark.createDataFrame(users + odd, USERS), spark.createDataFrame(items + odd, ITEMS), k, block, chunk).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["user"], r["place"])):
        found.setdefault(r["user"], []).append((r["item"], r["score"]))
        assert 1 <= r["visited"] <= r["blocks"] == -(-50 // block)
    for i, x in users:
        want = sorted(((-float(np.dot(x, y)), j) for j, y in items))[:k]
        assert found[i] == [(j, -s) for s, j in want]
    assert set(found) == {i for i, _ in users}


def test_users_stop_early(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(640, 8)) * (1.0 / (1 + np.arange(640)))[:, None]
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 8)))], USERS)
    got = top_inner_products(users, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], ITEMS), 3, 16)
    share = got.selectExpr("avg(visited / blocks) as share").first()["share"]
    assert share < 0.25, share  # 40 blocks; most users need the first few


def test_few_items_and_none(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], USERS)
    items = spark.createDataFrame([(5, [2.0, 1.0]), (6, [3.0, 0.0])], ITEMS)
    got = top_inner_products(users, items, 4).collect()
    assert sorted((r["user"], r["place"], r["item"], r["score"]) for r in got) == [(1, 1, 6, 3.0), (1, 2, 5, 2.0), (2, 1, 5, 0.0), (2, 2, 6, 0.0)]
    for left, right in ((users, items.limit(0)), (users.limit(0), items)):
        assert top_inner_products(left, right, 2).count() == 0


def test_no_product_in_the_plan(spark):
    users, items = spark.createDataFrame([(1, [1.0])], USERS), spark.createDataFrame([(5, [2.0])], ITEMS)
    plan = top_inner_products(users, items, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
