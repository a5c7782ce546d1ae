"""Data-parallel training: gradients are summed by Spark in one scan a step, the optimizer step is a small vector on the driver whose state lives as
long as the training. ``networks.train_in_barrier`` gives the same parameters in one job."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.plans.generation import N_CLASSES, N_FEATURES, SEED, gen_tabular, hashed, hashed_sql
from larkspan.plans.networks import HISTORY, train_in_barrier
from larkspan.plans.optimizer import Adam, Gradient
from larkspan.plans.scoring import matrix, samples
from larkspan.registry import query
from larkspan.session import TABLE_PREFIX, write_table
from larkspan.sources.tables import tables

MAX_DRIVER_PARAMETERS = 4_000_000
EPOCHS, RATE, STEPS = 4, 0.1, 3
#: Ratings in a bucket, about.
BUCKET_ROWS = 2_000_000


def summed_gradient(data: DataFrame, theta: np.ndarray, gradient: Gradient, x: str = "x", y: str = "y") -> tuple[np.ndarray, float, int, int]:
    """Gradient, loss, hits and rows over the whole table. Every partition gives one partial vector; vectors are
    added up in sixteen groups, so the driver receives sixteen at most."""
    if theta.size > MAX_DRIVER_PARAMETERS:
        raise ValueError("the parameter vector must fit the driver")
    shared = data.sparkSession.sparkContext.broadcast(theta)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                g, loss, hits = gradient(shared.value, matrix(b[x]), b[y].to_numpy())
                vec = np.concatenate([g, [loss, hits, len(b)]])
                total = vec if total is None else total + vec
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    # one row per partition; they are added up in groups of a few hundred on the executors, so the driver gets few
    parts = data.select(x, y).mapInPandas(partial, "v binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16)))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

    rows = parts.groupBy("g").applyInPandas(add, "v binary").collect()
    out = np.sum([np.frombuffer(r["v"]) for r in rows], axis=0) if rows else np.zeros(theta.size + 3)
    shared.unpersist()
    return out[:-3], out[-3], int(out[-2]), int(out[-1])


def softmax_gradient(n_classes: int) -> Gradient:
    """Softmax regression with bias: summed gradient, summed cross-entropy, right answers."""

    def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray):
        w = theta.reshape(n_classes, -1)
        xb = np.hstack([x, np.ones((len(x), 1))])
        z = xb @ w.T
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        rows = np.arange(len(y))
        loss, hits = -np.log(np.clip(p[rows, y], 1e-12, None)).sum(), (p.argmax(axis=1) == y).sum()
        p[rows, y] -= 1
        return (p.T @ xb).ravel(), loss, hits

    return gradient


def logistic_gradient() -> Gradient:
    def gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray):
        xb = np.hstack([x, np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-(xb @ theta)))
        loss = -(y * np.log(np.clip(p, 1e-12, None)) + (1 - y) * np.log(np.clip(1 - p, 1e-12, None))).sum()
        return xb.T @ (p - y), loss, ((p > 0.5) == (y > 0.5)).sum()

    return gradient


def train(data: DataFrame, size: int, gradient: Gradient, epochs: int = EPOCHS, rate: float = RATE, steps: int = STEPS) -> tuple[np.ndarray, list[tuple]]:
    """Mini-batch Adam over ``data(id, x, y)``: in every epoch each row falls into one of ``steps`` batches by the hash of seed, epoch and id; the
    moments last from step to step. The history has one entry per epoch: loss and accuracy of the rows as their batch met them."""
    theta, adam, history = np.zeros(size), Adam(size, rate), []
    for epoch in range(1, epochs + 1):
        met = np.zeros(3)
        for step in range(steps):
            batch = data.filter(hashed(F.lit(epoch), F.col("id")) % steps == step) if steps > 1 else data
            g, loss, hits, n = summed_gradient(batch, theta, gradient)
            if n:
                met += [loss, hits, n]
                theta = adam.step(theta, g / n)
        if not met[2]:
            break
        history.append((epoch, float(met[0] / met[2]), float(met[1] / met[2]), int(met[2])))
    return theta, history


def part_of(key: str) -> Column:
    """Train or test by the hash of the id: four rows in five train."""
    return F.when(hashed(F.col(key), seed=SEED + 20) % 5 == 0, "test").otherwise("train")


_PART_SQL = f"(case when {hashed_sql('o_orderkey', seed=SEED + 20)} % 5 = 0 then 'test' else 'train' end)"


def fit(spark: SparkSession, rows: DataFrame, size: int, gradient: Gradient) -> DataFrame:
    """Trains on ``rows(id, x, y)`` and returns per epoch: loss, accuracy, n_train, and the final test_loss, test_accuracy, n_test."""
    parts = write_table(rows.withColumn("part", part_of("id")), "training")
    theta, history = train(parts.filter("part = 'train'"), size, gradient)
    _, loss, hits, n = summed_gradient(parts.filter("part = 'test'"), theta, gradient)
    out = [(*h, float(loss / n) if n else None, float(hits / n) if n else None, n) for h in history]
    return spark.createDataFrame(out, HISTORY)


def _fit_sql(floor: str) -> str:
    return f"""select range::int as epoch, count_if(part = 'train') as n_train, count_if(part = 'test') as n_test, true as {floor}
      from (select {_PART_SQL} as part from orders), range(1, {EPOCHS + 1}) group by range"""


def two_classes(spark: SparkSession, d: str) -> DataFrame:
    return gen_tabular(spark, d).select("id", F.col("features").alias("x"), (F.col("label") < 2).cast("int").alias("y"))


@query("train_softmax", _fit_sql("accurate"))
def train_softmax(spark: SparkSession, d: str) -> DataFrame:
    """Softmax regression on the tabular samples: rows per part, and whether the model names eight held-out rows in ten rightly."""
    return softmax_history(spark, d).select("epoch", "n_train", "n_test", (F.col("test_accuracy") >= 0.8).alias("accurate"))


def softmax_history(spark: SparkSession, d: str) -> DataFrame:
    data = gen_tabular(spark, d).select("id", F.col("features").alias("x"), F.col("label").alias("y"))
    return fit(spark, data, N_CLASSES * (N_FEATURES + 1), softmax_gradient(N_CLASSES))


@query("train_softmax_history")
def train_softmax_history(spark: SparkSession, d: str) -> DataFrame:
    """Loss and accuracy of the same training in one barrier stage, for each epoch, and those of the rows held out."""
    data = gen_tabular(spark, d).select("id", F.col("features").alias("x"), F.col("label").alias("y"), part_of("id").alias("part"))
    gradient = softmax_gradient(N_CLASSES)
    _, history = train_in_barrier(data, np.zeros(N_CLASSES * (N_FEATURES + 1)), gradient, EPOCHS, RATE, STEPS)
    return spark.createDataFrame(history, HISTORY)


@query("iter_logreg_history")
def iter_logreg_history(spark: SparkSession, d: str) -> DataFrame:
    """Loss and accuracy of ``iter_logreg`` for each epoch, and those of the rows held out."""
    return logistic_history(spark, d)


@query("iter_logreg", _fit_sql("accurate"))
def iter_logreg(spark: SparkSession, d: str) -> DataFrame:
    """Binary logistic regression as an iterative job: two classes against the other three."""
    return logistic_history(spark, d).select("epoch", "n_train", "n_test", (F.col("test_accuracy") >= 0.7).alias("accurate"))


def logistic_history(spark: SparkSession, d: str) -> DataFrame:
    return fit(spark, two_classes(spark, d), N_FEATURES + 1, logistic_gradient())


@query("iter_kmeans", "select count(*) as n_rows, 10 as n_clusters, true as cost_fell, true as below_one_centre from embeddings")
def iter_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """k-means by hand: rows assigned, clusters with members, whether the cost never rose and beats a single centre's."""
    steps = kmeans_steps(spark, d).orderBy("step").collect()
    x = samples(spark, d).select(F.posexplode("x").alias("j", "v"))
    one = x.groupBy("j").agg(F.var_pop("v").alias("v"), F.count("*").alias("n")).agg(F.sum(F.col("v") * F.col("n")), F.max("n")).first()
    costs = [r["cost"] for r in steps]
    fell = all(b <= a * (1 + 1e-9) for a, b in zip(costs, costs[1:]))
    rows = [(int(one[1]), steps[-1]["n_clusters"], fell, bool(costs[-1] < one[0]))]
    return spark.createDataFrame(rows, "n_rows bigint, n_clusters int, cost_fell boolean, below_one_centre boolean")


def kmeans_steps(spark: SparkSession, d: str) -> DataFrame:
    """k-means by hand: assign in batches, sum per centre in Spark, move, until it settles."""
    data = write_table(samples(spark, d).select("vec_id", "x"), "kmeans")
    start = data.orderBy(F.xxhash64(F.lit(42), "vec_id"), "vec_id").limit(10).collect()
    centres = np.array([r["x"] for r in start])
    history = []
    for step in range(1, 11):
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                x, c = matrix(b["x"]), shared.value
                dist = ((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)) if len(x) else np.empty((0, len(c)))
                near = dist.argmin(axis=1)
                for k in np.unique(near):
                    mine = near == k
                    vec = np.concatenate([x[mine].sum(axis=0), [mine.sum(), dist[mine, k].sum()]])
                    yield pd.DataFrame({"k": int(k), "idx": np.arange(vec.size), "v": vec})

        sums = data.select("x").mapInPandas(assign, "k int, idx int, v double").groupBy("k", "idx").agg(F.sum("v").alias("v")).collect()
        table_ = np.zeros((len(centres), centres.shape[1] + 2))
        for r in sums:
            table_[r["k"], r["idx"]] = r["v"]
        filled = table_[:, -2] > 0
        moved = centres.copy()
        moved[filled] = table_[filled, :-2] / table_[filled, -2:-1]
        shift = float(((moved - centres) ** 2).sum())
        history.append((step, float(table_[:, -1].sum()), shift, int(filled.sum())))
        centres = moved
        if shift < 1e-6:
            break
    return spark.createDataFrame(history, "step int, cost double, shift double, n_clusters int")


@query(
    "iter_als",
    """select range::int as step, count(*) as n_ratings, true as fell from (select distinct o_custkey, l_suppkey from lineitem join orders on l_orderkey = o_orderkey),
      range(1, 5) group by range""",
)
def iter_als(spark: SparkSession, d: str) -> DataFrame:
    """Whether the error on the ratings falls from step to step."""
    rows, last = [], float("inf")
    for r in als_steps(spark, d).orderBy("step").collect():  # one row per step
        rows.append((r["step"], r["n_ratings"], r["rmse"] < last))
        last = r["rmse"]
    return spark.createDataFrame(rows, "step int, n_ratings bigint, fell boolean")


def als_steps(spark: SparkSession, d: str) -> DataFrame:
    """Alternating least squares by hand: factors are tables; each half step joins ratings with
    the fixed side, sums normal equations per id, and solves them in batches. Ratings lie in buckets by user, so that they never move: what
    moves are factors and sums, and no sums by user where the factors of the items can be broadcast."""
    rank, reg = 4, 0.1
    ratings = by_user(write_table(table_ratings(spark, d), "ratings"))
    small = ratings.select("item").distinct().count() * rank <= MAX_DRIVER_PARAMETERS
    sent = lambda factors: F.broadcast(factors) if small else factors
    items = write_table(ratings.select("item").distinct().select(
        "item", F.array(*[(F.pmod(F.xxhash64(F.lit(42), "item", F.lit(j)), F.lit(1000)) / 1000.0 - 0.5) for j in range(rank)]).alias("f")), "items")
    history = []
    for step in range(1, 5):
        users = write_table(solve(ratings, sent(items), "item", "user", rank, reg), "users")
        items = write_table(solve(ratings, users, "user", "item", rank, reg), "items")
        fit = ratings.join(users.withColumnRenamed("f", "uf"), "user").join(sent(items), "item")
        dot = F.aggregate(F.zip_with("uf", "f", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        rmse, n = fit.agg(F.sqrt(F.avg((dot - F.col("rating")) ** 2)), F.count("*")).first()
        history.append((step, float(rmse), n))
    return spark.createDataFrame(history, "step int, rmse double, n_ratings bigint")


def by_user(ratings: DataFrame) -> DataFrame:
    """The same rows in buckets by ``user``."""
    spark = ratings.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(ratings.count() / BUCKET_ROWS))
    kept = f"{TABLE_PREFIX}ratings_{uuid.uuid4().hex}"
    ratings.repartition(buckets, "user").write.bucketBy(buckets, "user").sortBy("user").format("parquet").saveAsTable(kept)
    return spark.table(kept)


def table_ratings(spark: SparkSession, d: str) -> DataFrame:
    """What a customer bought from a supplier, as one rating per pair: log of the quantity."""
    o, li = tables(spark, d, "orders", "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item")).agg(
        F.log1p(F.sum("l_quantity")).alias("rating"))


def solve(ratings: DataFrame, fixed: DataFrame, fixed_id: str, out_id: str, rank: int, reg: float) -> DataFrame:
    """New factors for ``out_id``. The normal equations are sums, so partial aggregation keeps
    a hot id from being gathered in one task."""
    joined = ratings.join(fixed, fixed_id)
    cells = [F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"a{i}_{j}") for i in range(rank) for j in range(i, rank)]
    rhs = [F.sum(F.col("f")[i] * F.col("rating")).alias(f"b{i}") for i in range(rank)]
    sums = joined.groupBy(out_id).agg(*cells, *rhs, F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = np.empty((len(b), rank, rank))
            for i in range(rank):
                for j in range(i, rank):
                    a[:, i, j] = a[:, j, i] = b[f"a{i}_{j}"]
            a += reg * b["n"].to_numpy()[:, None, None] * np.eye(rank)
            rhs_ = b[[f"b{i}" for i in range(rank)]].to_numpy()[:, :, None]
            yield pd.DataFrame({out_id: b[out_id], "f": list(np.linalg.solve(a, rhs_)[:, :, 0])})

    return sums.mapInPandas(run, f"{out_id} bigint, f array<double>")
