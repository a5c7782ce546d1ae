"""What a round, a rating or a sample may take, from the plans and calls that make it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspan.plans import graph, learning, training


def test_ratings_stay_in_their_buckets(spark):
    """Sums by user come from the buckets of the ratings: nothing is exchanged."""
    rows = [(u, i, float(u % 3 + i % 5)) for u in range(60) for i in range(u % 9 + 1)] + [(None, 1, 1.0), (3, None, 2.0)]
    ratings = training.by_user(spark.createDataFrame(rows, "user bigint, item bigint, rating double"))
    items = spark.range(9).select(F.col("id").alias("item"), F.array(*[F.lit(0.1) + F.col("id") * j for j in range(2)]).alias("f"))
    solved = training.solve(ratings, F.broadcast(items), "item", "user", 2, 0.1)
    text = solved._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text, text
    assert ratings.count() == len(rows) and solved.count() == 61


@pytest.mark.parametrize("rows", [7, 1_000_000])
def test_rounds_take_more_tasks_for_more_edges(spark, monkeypatch, rows):
    """A chain, a hub, a pair and loops; tasks grow with the edges, and the smallest neighbours are looked up without sorting."""
    seen, write = [], graph.write_table

    def watched(df, name):
        seen.append((name, spark.conf.get("spark.sql.shuffle.partitions"), df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(graph, "ROUND_ROWS", rows)
    monkeypatch.setattr(graph, "write_table", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = [(i, i + 1) for i in range(100, 140)] + [(900, 500 + i) for i in range(60)] + [(7, 3), (5, 5), (3, 7)]
        got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 500 for i in range(500, 560)}, 900: 500, 7: 3, 3: 3, 5: 5}
    rounds = [(n, plan) for name, n, plan in seen if name in ("large-star", "small-star")]
    assert {n for n, _ in rounds} == {"15" if rows == 7 else "4"}
    assert all("ShuffledHashJoin" in plan and "SortMergeJoin" not in plan for _, plan in rounds)


@pytest.mark.parametrize("job", [learning.tree_classifiers_quality, learning.classifiers_quality, learning.regressors_quality])
def test_samples_are_made_once(spark, sf_dir, monkeypatch, job):
    """Every model reads samples that were written, however many sets of labels are made of them."""
    made, keep = [], learning.write_table

    def watched(df, name):
        made.append("md5" in df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(learning, "write_table", watched)
    monkeypatch.setattr(learning, "_classify", lambda spark, models, data, key="id": learning._quality(spark, [(str(watched(data, "learn").count()), "", 0.0, 0)]))
    monkeypatch.setattr(learning, "_regress", lambda spark, models, data: learning._quality(spark, [(str(watched(data, "learn").count()), "", 0.0, 0)]))
    job(spark, sf_dir)
    assert made.count(True) == 1 and len(made) > 2


def test_equal_baskets_share_a_look(spark, sf_dir, monkeypatch):
    """The model is asked for each set of brands once; orders get the same predictions as when each asks."""
    from pyspark.ml.fpm import FPGrowthModel

    asked, transform = [], FPGrowthModel.transform
    monkeypatch.setattr(FPGrowthModel, "transform", lambda self, df: (asked.append(df), transform(self, df))[1])
    got = {r["l_orderkey"]: r["predicted"] for r in learning.fp_predictions(spark, sf_dir).collect()}
    data = learning.baskets(spark, sf_dir)
    assert asked[0].count() == data.select(F.sort_array("items")).distinct().count() < data.count()
    model = learning.FPGrowth(itemsCol="items", minSupport=learning.MIN_SUPPORT, minConfidence=0.1).fit(data)
    want = transform(model, data).filter("size(prediction) > 0").select("l_orderkey", F.array_join(F.sort_array("prediction"), ",").alias("p")).collect()
    assert got == {r["l_orderkey"]: r["p"] for r in want}
