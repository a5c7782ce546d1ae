"""Generated samples cost what is read of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.plans.generation import gen_tabular


def test_one_feature_is_made_alone_and_once(spark, sf_dir):
    """Two numbers of a row, a mixed feature's two parts, take four digests; filters may make them again, but no array of all features."""
    f = F.col("features")
    one = gen_tabular(spark, sf_dir).select(f[10].alias("v")).where("v > 0 and not isnan(v)")
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("md5(") <= 32
    assert one.agg(F.count("*")).first()[0] > 0
