"""What making generated samples and dividing them takes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from larkspan.plans import learning
from larkspan.plans.generation import gen_tabular, round_six
from larkspan.session import setting

LIMIT = "spark.sql.codegen.hugeMethodLimit"


class Watched:
    """A model that keeps the rows given to it and predicts nothing."""

    def __init__(self) -> None:
        self.given = []

    def fit(self, df):
        self.given.append(df)
        return self

    def transform(self, df):
        self.given.append(df)
        return df.withColumn("prediction", F.lit(0.0))


def test_quick_rounding_gives_the_same_numbers(spark, sf_dir):
    """Ties and near ties of both signs, zeros, large numbers, null and what is no number; then every feature of the samples."""
    odd = [float("nan"), float("inf"), float("-inf"), None, 0.0, -0.0, -1e-9, 5e-7, -5e-7, 4.9e-7, 1.0000005, -1.0000005, 2.0000015, 0.1234565, 999999.9999995, 1234567.1234565, 1e300]
    v = spark.createDataFrame([(x,) for x in odd], "v double").union(spark.range(20_000).selectExpr("(id - 10000) * 0.00000025D as v"))
    text = v.select(F.round("v", 6).cast("string").alias("a"), round_six(F.col("v")).cast("string").alias("b"))
    assert text.filter("not (a <=> b)").collect() == []
    a, b = (gen_tabular(spark, sf_dir, *how).select("id", "label", F.col("features").cast("string").alias("f")) for how in ((), (round_six,)))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < a.count()


def test_samples_are_made_by_compiled_code_without_unread_features(spark, sf_dir, monkeypatch):
    """The samples of the trees are written under the limit past which the JVM does not compile, and of the mixed features only the one that is read is made."""
    seen, write = [], learning.write_parts

    def watched(df, held_out, name):
        seen.append((spark.conf.get(LIMIT), df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, held_out, name)

    monkeypatch.setattr(learning, "write_parts", watched)
    with setting(spark, LIMIT, "65000"):
        monkeypatch.setattr(learning.mr, "DecisionTreeRegressor", lambda **k: Watched())
        monkeypatch.setattr(learning.mr, "RandomForestRegressor", lambda **k: Watched())
        monkeypatch.setattr(learning.mr, "GBTRegressor", lambda **k: Watched())
        assert learning.tree_regressors_quality(spark, sf_dir).count() == 3
        assert spark.conf.get(LIMIT) == "65000"
    (limit, plan), = seen
    assert limit == "8000"
    assert set(re.findall(r"inf_(\d+)#\d+ \* 0\.6", plan)) == {"0"}


def test_models_read_their_own_part(spark):
    """Train and test are the rows that ``split`` gives, with rows that come twice or have no id, and no scan hashes an id or reads the other part."""
    rows = [(i, float(i % 7), float(i)) for i in [*range(300), *range(40)]] + [(None, 1.0, 5.0)]
    data = spark.createDataFrame(rows, "id bigint, label double, features double")
    train, test = learning.split(data, "id")
    model = Watched()
    got = learning._regress(spark, {"one": model}, data).first()
    assert got["n_test"] == test.count() and got["value"] > 0
    for df, want in zip(model.given, (train, test), strict=True):
        assert sorted(map(str, df.collect())) == sorted(map(str, want.collect())) != []
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "md5" not in plan and "PartitionFilters: [isnotnull(held_out" in plan, plan
