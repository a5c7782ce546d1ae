"""Batch scoring of embeddings with a model learned from them, and evaluation of the scores.

The model is linear: one weight vector per class, the mean embedding of that class. Its
parameters are a table ``(name, label, idx, value)``. Scoring ships the weights to every task
once and works on Arrow batches; a model too large for that is scored by a join instead.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.plans.generation import hashed, hashed_sql
from larkspan.registry import query
from larkspan.session import spread
from larkspan.sources.tables import table

MAX_BROADCAST_PARAMETERS = 4_000_000
FAN_OUT, LEVELS = 4096, 6
CHUNK_ROWS = 50


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def parameters(spark: SparkSession, d: str) -> DataFrame:
    """Class means, one pass with partial aggregation of whole vectors."""
    means = (
        samples(spark, d).groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("w")))
    return means.select(F.format_string("class_%03d", "label").alias("name"), "label", F.posexplode("w").alias("idx", "value"))


def weights(params: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Labels and weight matrix, or None when the parameters exceed the broadcast bound."""
    if params.count() > MAX_BROADCAST_PARAMETERS:
        return None
    rows = params.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda p: p.value).alias("w")).orderBy("label").collect()
    return np.array([r["label"] for r in rows], dtype=np.int32), np.array([r["w"] for r in rows], dtype=np.float64)


def matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()) if len(s) else np.empty((0, 0))


def linear_scorer(spark: SparkSession, w: np.ndarray) -> Column:
    """``array<double>`` of one logit per class."""
    shared = spark.sparkContext.broadcast(w)

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wt = shared.value.T
        for x in batches:
            yield pd.Series(list(matrix(x) @ wt)) if len(x) else pd.Series([], dtype=object)

    return logits


def with_logits(spark: SparkSession, d: str, data: DataFrame | None = None, params: DataFrame | None = None) -> DataFrame:
    """``vec_id, label, classes, logits``: by broadcast weights, or by a join when too large."""
    data = data if data is not None else samples(spark, d)
    params = params if params is not None else parameters(spark, d)
    held = weights(params)
    if held is None:
        return logits_by_join(data, params)
    labels, w = held
    classes = F.array(*[F.lit(int(v)) for v in labels])
    return data.select("vec_id", "label", classes.alias("classes"), linear_scorer(spark, w)("x").alias("logits"))


def logits_by_join(data: DataFrame, params: DataFrame) -> DataFrame:
    """The same logits for a model of any size: components meet weights on their index."""
    cells = data.select("vec_id", data.label.alias("label"), F.posexplode("x").alias("idx", "v"))
    by_class = cells.join(params.select(F.col("label").alias("k"), "idx", "value"), "idx").groupBy("vec_id", "label", "k").agg(
        F.sum(F.col("v") * F.col("value")).alias("logit"))
    ordered = F.sort_array(F.collect_list(F.struct("k", "logit")))
    return by_class.groupBy("vec_id", "label").agg(ordered.alias("s")).select(
        "vec_id", "label", F.col("s.k").alias("classes"), F.col("s.logit").alias("logits"))


def top1(classes: str = "classes", logits: str = "logits") -> Column:
    return F.element_at(classes, F.array_position(logits, F.array_max(logits)).cast("int"))


def softmax(logits: str = "logits") -> Column:
    top = F.array_max(logits)
    exps = F.transform(logits, lambda v: F.exp(v - top))
    return F.transform(exps, lambda v: v / F.aggregate(exps, F.lit(0.0), lambda s, t: s + t))


def hash_tree(df: DataFrame, idx: str, text: Column, keys: list[str] | None = None) -> DataFrame:
    """SHA-256 over rows in ``idx`` order, as a tree of ``LEVELS`` levels: at most ``FAN_OUT`` children per hash and a last level without
    numbers, which covers every 64-bit id, so the definition does not depend on the data or its partitioning."""
    keys = keys or []
    node = df.select(*keys, F.col(idx).cast("bigint").alias("i"), text.alias("h"))
    for level in range(LEVELS):
        up = F.lit(0).cast("bigint") if level == LEVELS - 1 else F.floor(F.col("i") / FAN_OUT)
        node = node.groupBy(*keys, up.alias("i")).agg(
            F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda r: r.h)), 256).alias("h"))
    return node.select(*keys, F.col("h").alias("fingerprint"))


def hash_tree_sql(name: str, source: str, idx: str, text: str, keys: str = "") -> str:
    """The same as common table expressions; the last one is called ``name`` and has the keys and h."""
    keep = f"{keys}, " if keys else ""
    ctes = [f"{name}_0 as (select {keep}({idx})::bigint as i, {text} as h from {source})"]
    for level in range(1, LEVELS + 1):
        up = "0" if level == LEVELS else f"floor(i / {FAN_OUT})::bigint"
        to = name if level == LEVELS else f"{name}_{level}"
        ctes.append(f"{to} as (select {keep}up as i, sha256(string_agg(h, ',' order by i)) as h from (select *, {up} as up from {name}_{level - 1}) group by all)")
    return ", ".join(ctes)


# The scorer in SQL: components, class means, logits per sample and class.
CELLS_SQL = """cells as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as j from embeddings),
  params as (select label as k, j, avg(x) as w from cells group by all),
  scores as (select vec_id, any_value(label) as label, k, sum(x * w) as logit from cells join params using (j) group by vec_id, k)"""

_PRED_SQL = f"""with {CELLS_SQL},
  preds as (select vec_id, any_value(label) as label, arg_max(k, logit) as prediction, max(logit) as top from scores group by vec_id),
  probs as (select s.vec_id, s.label, k, logit, prediction, exp(logit - top) / sum(exp(logit - top)) over (partition by s.vec_id) as p
            from scores s join preds using (vec_id))"""


@query("score_broadcast", _PRED_SQL + " select vec_id, prediction, round(top, 6) as score from preds")
def score_broadcast(spark: SparkSession, d: str) -> DataFrame:
    return with_logits(spark, d).select("vec_id", top1().alias("prediction"), F.round(F.array_max("logits"), 6).alias("score"))


@query("score_by_join", _PRED_SQL + " select vec_id, prediction, round(top, 6) as score from preds")
def score_by_join(spark: SparkSession, d: str) -> DataFrame:
    """The way taken when the weights do not fit a broadcast."""
    return logits_by_join(samples(spark, d), parameters(spark, d)).select(
        "vec_id", top1().alias("prediction"), F.round(F.array_max("logits"), 6).alias("score"))


@query("score_predict_batch", _PRED_SQL + " select vec_id, prediction::double as prediction from preds")
def score_predict_batch(spark: SparkSession, d: str) -> DataFrame:
    """The built-in batch prediction function: loads the model once per Python worker."""
    params = parameters(spark, d)
    held = weights(params)
    if held is None:
        return score_by_join(spark, d).select("vec_id", F.col("prediction").cast("double").alias("prediction"))
    labels, w = held
    shared = spark.sparkContext.broadcast((labels, w))

    def make_predict():
        classes, wt = shared.value[0], shared.value[1].T

        def predict(x: np.ndarray) -> np.ndarray:
            return classes[(x @ wt).argmax(axis=1)].astype(np.float64)

        return predict

    predict = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=1024, input_tensor_shapes=[[w.shape[1]]])
    return samples(spark, d).select("vec_id", predict("x").alias("prediction"))


_SEED, _FEATURES, _CLASSES = 42, 8, 5


@query(
    "score_generated",
    f"""with x as (select o_orderkey as id, [{hashed_sql('o_orderkey', 'j', seed=_SEED)} % 1000003 / 1000003.0::double * 2 - 1 for j in range({_FEATURES})] as x from orders),
      s as (select id, [list_dot_product(x, [sin((k * {_FEATURES} + j)::double) for j in range({_FEATURES})]) for k in range({_CLASSES})] as s from x),
      p as (select id, list_position(s, list_max(s)) - 1 as prediction from s), """ + hash_tree_sql("tree", "p", "id", "id || ':' || prediction")
    + " select prediction::int as prediction, count(*) as n, (select h from tree) as fingerprint from p group by 1",
)
def score_generated(spark: SparkSession, d: str) -> DataFrame:
    """Only a seed goes to the executors: each order id gets eight features made from
    (seed, id, j), is scored, and the run is summed up with its fingerprint."""
    n_features, n_classes = _FEATURES, _CLASSES
    feature = lambda j: hashed(F.col("id"), j, seed=_SEED) % 1_000_003 / 1_000_003 * 2 - 1
    wts = np.sin(np.arange(n_classes * n_features, dtype=np.float64)).reshape(n_classes, n_features)
    rows = spread(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))).select(
        "id", F.array(*[feature(j) for j in range(n_features)]).alias("x"))
    scored = rows.select("id", linear_scorer(spark, wts)("x").alias("logits")).select(
        "id", (F.array_position("logits", F.array_max("logits")) - 1).cast("int").alias("prediction"))
    mark = hash_tree(scored, "id", F.concat_ws(":", F.col("id").cast("string"), F.col("prediction").cast("string"))).first()["fingerprint"]
    return scored.groupBy("prediction").agg(F.count("*").alias("n")).withColumn("fingerprint", F.lit(mark))


@query(
    "softmax_top1",
    _PRED_SQL + """ select vec_id, any_value(prediction) as prediction, round(max(p), 8) as p_top, round(sum(p), 8) as p_sum,
      round(-sum(p * ln(p)), 7) as entropy from probs group by 1""",
)
def softmax_top1(spark: SparkSession, d: str) -> DataFrame:
    scored = with_logits(spark, d).select("vec_id", top1().alias("prediction"), softmax().alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda s, v: s + f(v))
    return scored.select(
        "vec_id", "prediction", F.round(F.array_max("p"), 8).alias("p_top"), F.round(total(lambda v: v), 8).alias("p_sum"),
        F.round(-total(lambda v: v * F.log(v)), 7).alias("entropy"))


@query(
    "eval_loss_accuracy",
    _PRED_SQL + """ select round(avg(-ln(p)) filter (k = label), 8) as loss, round(avg((prediction = label)::int) filter (k = label), 8) as accuracy,
      count(*) filter (k = label) as n_rows from probs""",
)
def eval_loss_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(with_logits(spark, d)).select(
        F.round("loss", 8).alias("loss"), F.round("accuracy", 8).alias("accuracy"), "n_rows")


def evaluate(scored: DataFrame, *keys: str) -> DataFrame:
    """Mean cross-entropy, accuracy and row count per key."""
    own = F.element_at(softmax(), F.array_position("classes", F.col("label")).cast("int"))
    return scored.groupBy(*keys).agg(
        F.avg(-F.log(own)).alias("loss"), F.avg((top1() == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n_rows"))


@query(
    "prediction_fingerprint",
    _PRED_SQL + ", " + hash_tree_sql("tree", "preds", "vec_id", "vec_id || ':' || prediction") + " select h as fingerprint, (select count(*) from preds) as n_rows from tree",
)
def prediction_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    preds = with_logits(spark, d).select("vec_id", top1().alias("prediction"))
    text = F.concat_ws(":", F.col("vec_id").cast("string"), F.col("prediction").cast("string"))
    return hash_tree(preds, "vec_id", text).withColumn("n_rows", F.lit(preds.count()))


@query(
    "model_fingerprint",
    f"with {CELLS_SQL}, " + hash_tree_sql("named", "params", "j", "(round(w * 1000000)::bigint)::varchar", "k") + ", " + hash_tree_sql("whole", "named", "k", "h")
    + " select 'class_' || lpad(k::varchar, 3, '0') as name, named.h as fingerprint, whole.h as model from named, whole",
)
def model_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One hash per named parameter, and one over all of them in name order."""
    text = F.round(F.col("value") * 1_000_000).cast("bigint").cast("string")
    per_name = hash_tree(parameters(spark, d), "idx", text, ["name", "label"])
    model = hash_tree(per_name, "label", F.col("fingerprint")).first()["fingerprint"]
    return per_name.select("name", "fingerprint", F.lit(model).alias("model"))


@query(
    "hybrid_route",
    _PRED_SQL + f""", far as (select vec_id, arg_min(k, dist) as prediction from (
        select vec_id, k, sum((x - w) * (x - w)) as dist from cells join params using (j) group by all) group by 1)
      select p.vec_id, p.vec_id // {CHUNK_ROWS} as chunk, case when (p.vec_id // {CHUNK_ROWS}) % 2 = 0 then 'a' else 'b' end as route,
             case when (p.vec_id // {CHUNK_ROWS}) % 2 = 0 then p.prediction else f.prediction end as prediction
      from preds p join far f using (vec_id)""",
)
def hybrid_route(spark: SparkSession, d: str) -> DataFrame:
    """Even chunks go to the dot-product scorer, odd chunks to the distance scorer. The nearest
    class mean is a linear model too: one more weight of -|w|^2 / 2 against a constant 1."""
    params = parameters(spark, d)
    data = samples(spark, d).withColumn("chunk", F.floor(F.col("vec_id") / CHUNK_ROWS))
    bias = params.groupBy("name", "label").agg((F.max("idx") + 1).alias("idx"), (F.sum(F.col("value") ** 2) * -0.5).alias("value"))
    a = with_logits(spark, d, data.filter("chunk % 2 = 0"), params).withColumn("route", F.lit("a"))
    near = data.filter("chunk % 2 = 1").withColumn("x", F.concat("x", F.array(F.lit(1.0))))
    b = with_logits(spark, d, near, params.unionByName(bias)).withColumn("route", F.lit("b"))
    return a.unionByName(b).select(
        "vec_id", F.floor(F.col("vec_id") / CHUNK_ROWS).alias("chunk"), "route", top1().alias("prediction"))


@query(
    "registry_join",
    f"""with {CELLS_SQL}, reg(slot, name, kind, num_classes) as (values (0, 'dot', 'linear', 10), (1, 'norm', 'norm', 1), (2, 'first', 'pick', 1)),
      tot as (select vec_id, any_value(label) as label, sqrt(sum(x * x)) as norm, max(x) filter (j = 0) as first from cells group by 1),
      top as (select vec_id, max(logit) as top from scores group by 1)
      select vec_id, name, num_classes, round(case kind when 'linear' then top when 'norm' then norm else first end, 6) as score
      from tot join top using (vec_id) join reg on vec_id % 3 = slot""",
)
def registry_join(spark: SparkSession, d: str) -> DataFrame:
    """A registry row names the scorer of each sample; scorers are chosen by their kind."""
    # Registered scorers.
    registry = spark.createDataFrame(
        [(0, "dot", "linear", 10), (1, "norm", "norm", 1), (2, "first", "pick", 1)],
        "slot bigint, name string, kind string, num_classes int")
    scored = with_logits(spark, d).select("vec_id", F.array_max("logits").alias("top"))
    data = samples(spark, d).withColumn("slot", F.col("vec_id") % 3).join(registry, "slot").join(scored, "vec_id")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    score = F.when(F.col("kind") == "linear", F.col("top")).when(F.col("kind") == "norm", norm).otherwise(F.col("x")[0])
    return data.select("vec_id", "name", "num_classes", F.round(score, 6).alias("score"))


@query(
    "model_size",
    f"""with {CELLS_SQL} select coalesce('class_' || lpad(k::varchar, 3, '0'), 'all') as name, count(*) as n_parameters,
      round(count(*) * 4 / 1048576.0, 6)::double as megabytes from params group by rollup (k)""",
)
def model_size(spark: SparkSession, d: str) -> DataFrame:
    sized = parameters(spark, d).rollup("name").agg(F.count("*").alias("n_parameters"))
    return sized.select(F.coalesce("name", F.lit("all")).alias("name"), "n_parameters",
                        F.round(F.col("n_parameters") * 4 / 1048576, 6).alias("megabytes"))


@query(
    "score_with_errors",
    """with t as (select event_id, value, cast(json_extract_string(props, '$.k') as int) as k from events)
       select event_id, case when k % 10 <> 0 then round(value / (k % 10), 8) end as score,
              case when k % 10 = 0 then 'division by zero' end as error from t""",
)
def score_with_errors(spark: SparkSession, d: str) -> DataFrame:
    """A bad row becomes an error row; the run goes on."""

    @F.pandas_udf("score double, error string")
    def score(value: pd.Series, k: pd.Series) -> pd.DataFrame:
        bad = k % 10 == 0
        return pd.DataFrame({"score": value / (k % 10).where(~bad), "error": pd.Series("division by zero", index=k.index).where(bad, None)})

    ev = table(spark, d, "events").select("event_id", "value", F.from_json("props", "k int")["k"].alias("k"))
    return ev.select("event_id", score("value", "k").alias("r")).select("event_id", F.round("r.score", 8).alias("score"), "r.error")


@query(
    "chunk_metrics",
    _PRED_SQL + f""" select vec_id // {CHUNK_ROWS} as chunk, count(*) as samples, sum((prediction = label)::int)::bigint as hits, true as timed, true as placed, true as sized
      from preds group by 1""",
)
def chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk of scoring work: samples and hits, and whether time, place and memory were measured beside them."""
    m = chunk_runs(samples(spark, d), parameters(spark, d))
    return m.select(
        "chunk", "samples", "hits", ((F.col("seconds") > 0) & (F.col("throughput") > 0)).alias("timed"),
        ((F.col("hosts") >= 1) & F.col("device").isin("cpu", "gpu")).alias("placed"), (F.col("memory_mb") > 0).alias("sized"))


def weight_blocks(params: DataFrame, bound: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and weight rows in label order, in blocks of at most ``bound`` parameters (one class at least): a block can be broadcast,
    whatever the size of the model."""
    bound = bound or MAX_BROADCAST_PARAMETERS
    rows = params.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda p: p.value).alias("w"))
    held: list = []
    for r in rows.orderBy("label").toLocalIterator():
        held.append(r)
        if sum(len(x["w"]) for x in held) + len(r["w"]) > bound:
            yield np.array([x["label"] for x in held], np.int32), np.array([x["w"] for x in held], np.float64)
            held = []
    if held:
        yield np.array([x["label"] for x in held], np.int32), np.array([x["w"] for x in held], np.float64)


def chunk_runs(data: DataFrame, params: DataFrame, bound: int | None = None) -> DataFrame:
    """Per chunk: samples, hits, seconds, throughput, hosts, device (what Spark gave the task) and the workers' peak memory.
    Every block of weights is one pass over the rows in the same job; rows carry their best class so far."""
    spark = data.sparkSession
    start = data.select(
        F.floor(F.col("vec_id") / CHUNK_ROWS).alias("chunk"), "label", "x", F.lit(float("-inf")).alias("best"), F.lit(None).cast("int").alias("pick"),
        F.lit(0.0).alias("seconds"), F.lit("").alias("host"), F.lit("").alias("device"), F.lit(0.0).alias("memory_mb"))
    out = start
    for labels, w in weight_blocks(params, bound):
        shared = spark.sparkContext.broadcast((labels, w))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import resource
            import socket

            from pyspark import TaskContext

            labels, w = shared.value
            device = "gpu" if "gpu" in TaskContext.get().resources() else "cpu"
            for b in batches:
                if not len(b):
                    continue
                begun = time.perf_counter()
                logits = matrix(b["x"]) @ w.T
                top = logits.max(axis=1)
                better = top > b["best"].to_numpy()
                pick = b["pick"].astype("float64").mask(better, labels[logits.argmax(axis=1)])
                spent = time.perf_counter() - begun
                yield b.assign(best=np.maximum(top, b["best"]), pick=pick.astype("Int32"), seconds=b["seconds"] + spent / len(b), host=socket.gethostname(),
                               device=device, memory_mb=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)

        out = out.mapInPandas(run, start.schema)
    return out.groupBy("chunk").agg(
        F.count("*").alias("samples"), F.sum("seconds").alias("seconds"), F.sum((F.col("pick") == F.col("label")).cast("bigint")).alias("hits"),
        F.count_distinct("host").alias("hosts"), F.max("device").alias("device"), F.max("memory_mb").alias("memory_mb"),
    ).withColumn("throughput", F.col("samples") / F.greatest("seconds", F.lit(1e-9)))


@query(
    "score_mlp",
    f"""with {CELLS_SQL}, hidden as (select vec_id, k, greatest(logit, 0) as h from scores),
      tot as (select vec_id, sum(h) as hs from hidden group by 1)
      select vec_id, arg_max(k, 1.1 * h - 0.1 * hs) as prediction, round(max(1.1 * h - 0.1 * hs), 6) as score
      from hidden join tot using (vec_id) group by 1""",
)
def score_mlp(spark: SparkSession, d: str) -> DataFrame:
    """One hidden layer: rectified class scores, then a second layer that lets classes inhibit
    each other. The wide first layer runs in NumPy batches, the small second one in SQL."""
    hidden = with_logits(spark, d).withColumn("h", F.transform("logits", lambda v: F.greatest(v, F.lit(0.0))))
    hidden = hidden.withColumn("hs", F.aggregate("h", F.lit(0.0), lambda s, v: s + v))
    out = hidden.withColumn("out", F.transform("h", lambda v: v * 1.1 - F.col("hs") * 0.1))
    return out.select("vec_id", top1("classes", "out").alias("prediction"), F.round(F.array_max("out"), 6).alias("score"))
