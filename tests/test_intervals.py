"""Interval joins against all pairs: widths from nothing to 2**61, nulls, repeated rows, one hot node on either side."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import intervals
from larkspan.operators.intervals import interval_join, overlap_join

POINTS, RANGES = "k string, at bigint, p int", "k string, low bigint, high bigint, r int"


def points(n=300, seed=1):
    rnd = random.Random(seed)
    at = lambda: rnd.choice([rnd.randrange(-50, 50), rnd.randrange(-(2**61), 2**61), 7, None if rnd.random() < 0.2 else -1])
    return [(rnd.choice(["hot"] * 6 + ["a", None]), at(), i // 2) for i in range(n)] + [("hot", 7, 1000)] * 100


def ranges(n=120, seed=2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        low = rnd.choice([rnd.randrange(-60, 60), rnd.randrange(-(2**61), 2**61)])
        high = low + rnd.choice([0, 1, 2, 3, rnd.randrange(100), 2 ** rnd.randrange(61), -5])
        out.append((rnd.choice(["hot"] * 6 + ["a", None]), rnd.choice([low] * 9 + [None]), rnd.choice([high] * 9 + [None]), i))
    return out + [("hot", -100, 100, 500)] * 30 + [("hot", -(2**61), 2**61, 501)]


def met(k, at, q, low, high, keyed):
    return None not in (at, low, high) and low <= at < high and (not keyed or (k is not None and k == q))


@pytest.mark.parametrize("share", [1, 50, 1000])
@pytest.mark.parametrize("keyed", [True, False])
def test_interval_join(spark, share, keyed):
    ps, rs = points(), ranges()
    left = spark.createDataFrame(ps, POINTS)
    right = spark.createDataFrame(rs, RANGES)
    if not keyed:
        left, right = left.drop("k"), right.drop("k")
    got = interval_join(left, right, F.col("at"), F.col("low"), F.col("high"), ["k"] if keyed else [], share)
    assert got.columns == [*(["k"] if keyed else []), "at", "p", "low", "high", "r"]
    want = sorted((at, p, low, high, r) for k, at, p in ps for q, low, high, r in rs if met(k, at, q, low, high, keyed))
    assert want and sorted(tuple(x) for x in got.select("at", "p", "low", "high", "r").collect()) == want


@pytest.mark.parametrize("share", [1, 200])
def test_overlap_join(spark, share):
    ls, rs = ranges(80, 3), ranges(80, 4)
    left = spark.createDataFrame(ls, RANGES)
    right = spark.createDataFrame(rs, RANGES).withColumnsRenamed({"low": "lo", "high": "hi", "r": "s"})
    got = overlap_join(left, right, ("low", "high"), ("lo", "hi"), ["k"], share).select("r", "s").collect()
    filled = lambda rows: [x for x in rows if None not in x and x[1] < x[2]]
    want = sorted((r, s) for k, low, high, r in filled(ls) for q, lo, hi, s in filled(rs) if k == q and low < hi and lo < high)
    assert want and sorted(tuple(x) for x in got) == want


def test_copies_are_bounded_by_the_logarithm(spark):
    rows = [("a", low, low + width, i) for i, (low, width) in enumerate((low, w) for low in (-(2**60) - 3, -7, 0, 5, 2**40 + 1) for w in (1, 2, 7, 1000, 2**31 + 5, 2**60 - 1))]
    nodes = intervals._range_nodes(spark.createDataFrame(rows, RANGES), F.col("low"), F.col("high"), ["k"])
    pieces = nodes.groupBy("r", "low", "high").agg(
        F.count("*").alias("n"), F.sum(F.expr("shiftleft(1L, __level)")).alias("width"), F.min(F.expr("__node * shiftleft(1L, __level)")).alias("first")).collect()
    assert len(pieces) == len(rows)
    for x in pieces:
        assert x["width"] == x["high"] - x["low"] and x["first"] == x["low"]  # a partition of the range
        assert x["n"] <= 2 * (x["high"] - x["low"]).bit_length()


def test_hot_nodes_are_cut(spark):
    left = spark.range(0, 4000, 1, 4).select(F.lit(5).cast("bigint").alias("at"), F.col("id").alias("p"))
    right = spark.createDataFrame([(0, 16, 1), (0, 16, 2), (5, 6, 3)], "low bigint, high bigint, r int")
    sizes = intervals._heavy(intervals._point_nodes(left.withColumnRenamed("at", "__at").withColumn("__row", F.col("p")), [
        {"__level": 4, "first": 0, "last": 0}, {"__level": 0, "first": 5, "last": 5}]), ["__level", "__node"], 16, "cuts").collect()
    assert sorted(x["cuts"] for x in sizes) == [8, 8]
    assert interval_join(left, right, F.col("at"), F.col("low"), F.col("high"), [], 16).groupBy("r").count().collect().__len__() == 3


@pytest.mark.parametrize("by", [[], ["k"]])
def test_empty_sides_and_clashing_names(spark, by):
    some_points, some_ranges = spark.createDataFrame(points(10), POINTS), spark.createDataFrame(ranges(10), RANGES)
    if not by:
        some_points, some_ranges = some_points.drop("k"), some_ranges.drop("k")
    bounds = (F.col("at"), F.col("low"), F.col("high"), by)
    for left, right in ((some_points.limit(0), some_ranges), (some_points, some_ranges.limit(0)), (some_points, some_ranges.withColumn("high", F.col("low")))):
        got = interval_join(left, right, *bounds)
        assert got.count() == 0 and got.columns == [*by, "at", "p", "low", "high", "r"]
    with pytest.raises(ValueError, match="p"):
        interval_join(some_points, some_ranges.withColumn("p", F.lit(1)), *bounds)
def test_copies_are_not_broadcast(spark):
    """Copies of ranges lie in files far smaller than their rows. Without nodes to cut the join would go by the files' size."""
    left = spark.createDataFrame(points(), POINTS)
    right = spark.createDataFrame(ranges(), RANGES)
    got = interval_join(left, right, F.col("at"), F.col("low"), F.col("high"), ["k"], share=1)
    rows = got._jdf.queryExecution().executedPlan()
    assert rows.executeCollect() is not None
    plan = rows.toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
