"""Statistics: tests, densities, matrix products, and quality metrics of predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import ChiSquareTest, Correlation, KolmogorovSmirnovTest, Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.skew import prefix
from larkspan.plans.generation import normal, normal_sql, uniform, uniform_sql
from larkspan.plans.scoring import CELLS_SQL, matrix, samples, top1, with_logits
from larkspan.registry import query
from larkspan.sources.tables import table, tables

TOP = 5
MAX_GRAM_COLUMNS = 4_000


@query(
    "stat_tests",
    """with l as (select l_quantity as a, l_discount as b, l_tax as c, l_returnflag as f, l_linestatus as s, count(*) over () as n from lineitem),
      r as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb,
        rank() over (order by c) + (count(*) over (partition by c) - 1) / 2.0 as rc from l),
      cell as (select f, s, count(*) as seen, any_value(n) as n from l group by all),
      grid as (select f.f, s.s, f.m * s.m / f.n::double as want, coalesce(seen, 0) as seen from (select f, count(*) as m, any_value(n) as n from l group by 1) f, (select s, count(*) as m from l group by 1) s
        left join cell on cell.f = f.f and cell.s = s.s)
      select 'pearson' as test, unnest(['quantity_discount', 'quantity_tax', 'discount_tax']) as measure, round(unnest([corr(a, b), corr(a, c), corr(b, c)]), 7) as value from l
      union all select 'spearman', unnest(['quantity_discount', 'quantity_tax', 'discount_tax']), round(unnest([corr(ra, rb), corr(ra, rc), corr(rb, rc)]), 7) from r
      union all select 'chi_square', 'statistic', round(sum((seen - want) * (seen - want) / want), 4) from grid
      union all select 'summary', unnest(['mean_quantity', 'variance_quantity', 'count']), round(unnest([avg(a), var_samp(a), count(*)::double]), 5) from l""",
)
def stat_tests(spark: SparkSession, d: str) -> DataFrame:
    """Correlation matrices, chi-square independence, and a summary."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    v = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(li)
    pearson = Correlation.corr(v, "features").first()[0].toArray()
    spearman = Correlation.corr(v, "features", "spearman").first()[0].toArray()
    coded = StringIndexer(inputCols=["l_returnflag", "l_linestatus"], outputCols=["flag", "status"]).fit(li).transform(li)
    chi = ChiSquareTest.test(VectorAssembler(inputCols=["status"], outputCol="f").transform(coded), "f", "flag", flatten=True).first()
    s = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).first()["s"]
    pairs = {"quantity_discount": (0, 1), "quantity_tax": (0, 2), "discount_tax": (1, 2)}
    rows = [(test, name, round(float(m[at]), 7)) for test, m in (("pearson", pearson), ("spearman", spearman)) for name, at in pairs.items()]
    rows += [("chi_square", "statistic", round(float(chi["statistic"]), 4))]
    rows += [("summary", n, round(float(x), 5)) for n, x in (("mean_quantity", s["mean"][0]), ("variance_quantity", s["variance"][0]), ("count", s["count"]))]
    return spark.createDataFrame(rows, "test string, measure string, value double")


@query(
    "sample_stats",
    """select 'quantity' as name, count(*) as n, round(avg(l_quantity), 7) as mean, round(var_samp(l_quantity), 5) as variance, count_if(l_quantity <> 0) as nonzeros,
         max(l_quantity) as high, min(l_quantity) as low, round(sum(l_quantity), 2) as norm_l1, round(sqrt(sum(l_quantity * l_quantity)), 5) as norm_l2,
         round(corr(l_quantity, l_extendedprice), 8) as corr_price from lineitem
       union all select 'discount', count(*), round(avg(l_discount), 7), round(var_samp(l_discount), 5), count_if(l_discount <> 0), max(l_discount), min(l_discount),
         round(sum(l_discount), 2), round(sqrt(sum(l_discount * l_discount)), 5), round(corr(l_discount, l_extendedprice), 8) from lineitem""",
)
def sample_stats(spark: SparkSession, d: str) -> DataFrame:
    """Column summary of a vector column in one pass, and correlation with the price."""
    v = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="f").transform(table(spark, d, "lineitem"))
    names = ["mean", "variance", "numNonZeros", "max", "min", "normL1", "normL2"]
    s = v.agg(Summarizer.metrics(*names).summary(F.col("f")).alias("s"), F.count("*").alias("n"),
              F.corr("l_quantity", "l_extendedprice").alias("c0"), F.corr("l_discount", "l_extendedprice").alias("c1"))
    wide = s.select("n", *[vector_to_array(f"s.{m}").alias(m) for m in names], F.array("c0", "c1").alias("c"))
    rows = wide.select("*", F.inline(F.array(F.struct(F.lit(0).alias("i"), F.lit("quantity").alias("name")), F.struct(F.lit(1).alias("i"), F.lit("discount").alias("name")))))
    at = lambda c: F.col(c)[F.col("i")]
    return rows.select("name", "n", F.round(at("mean"), 7).alias("mean"), F.round(at("variance"), 5).alias("variance"), at("numNonZeros").cast("bigint").alias("nonzeros"),
                       at("max").alias("high"), at("min").alias("low"), F.round(at("normL1"), 2).alias("norm_l1"), F.round(at("normL2"), 5).alias("norm_l2"),
                       F.round(at("c"), 8).alias("corr_price"))


@query(
    "random_columns",
    f"""with r as (select {uniform_sql('o_orderkey', 1, seed=5)} as u, {normal_sql('o_orderkey', 2, seed=5)} as z from orders),
      v as (select unnest(['uniform', 'normal', 'exponential', 'log_normal']) as name, unnest([u, z, -ln(u), exp(z)]) as v from r)
      select name, count(*) as n, round(avg(v), 8) as mean, round(stddev(v), 8) as sd from v group by 1""",
)
def random_columns(spark: SparkSession, d: str) -> DataFrame:
    """Seeded uniform, normal, exponential and Poisson-like columns per order, summed up."""
    o = table(spark, d, "orders").select("o_orderkey")
    u, z = uniform(F.col("o_orderkey"), 1, seed=5), normal(F.col("o_orderkey"), 2, seed=5)
    long = o.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), c.alias("v")) for n, c in
        (("uniform", u), ("normal", z), ("exponential", -F.log(u)), ("log_normal", F.exp(z)))])))
    return long.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("v"), 8).alias("mean"), F.round(F.stddev("v"), 8).alias("sd"))


@query("ks_hypothesis")
def ks_hypothesis(spark: SparkSession, d: str) -> DataFrame:
    """Two samples against the standard normal: seeded normals, which fit, and scaled balances,
    which do not."""
    c = table(spark, d, "customer")
    low, high = c.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    z = c.select(normal(F.col("c_custkey"), 3, seed=5).alias("z"), ((F.col("c_acctbal") - low) / (high - low)).alias("u"))
    normal_fit = KolmogorovSmirnovTest.test(z, "z", "norm", 0.0, 1.0).first()
    uniform_fit = KolmogorovSmirnovTest.test(z, "u", "norm", 0.0, 1.0).first()
    rows = [("seeded_normal", float(normal_fit["pValue"]), float(normal_fit["statistic"])), ("scaled_balance", float(uniform_fit["pValue"]), float(uniform_fit["statistic"]))]
    return spark.createDataFrame(rows, "sample string, p_value double, statistic double")


@query(
    "ks_uniform",
    """with v as (select c_acctbal, count(*) as c from customer group by 1), n as (select count(*) as n, min(c_acctbal) as lo, max(c_acctbal) as hi from customer),
         r as (select c_acctbal, sum(c) over (order by c_acctbal) as upto, c from v)
       select n, round(max(greatest(abs(upto / n - (c_acctbal - lo) / (hi - lo)), abs((upto - c) / n - (c_acctbal - lo) / (hi - lo)))), 10) as statistic from r, n group by n""",
)
def ks_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Largest distance between the empirical distribution of the balances and a uniform one."""
    c = table(spark, d, "customer").select("c_acctbal")
    n, low, high = c.agg(F.count("*"), F.min("c_acctbal"), F.max("c_acctbal")).first()
    run = prefix(c.groupBy("c_acctbal").agg(F.count("*").alias("c")), [], ["c_acctbal"], {"upto": ("sum", "c")})
    expected = (F.col("c_acctbal") - low) / (high - low)
    gap = F.greatest(F.abs(F.col("upto") / n - expected), F.abs((F.col("upto") - F.col("c")) / n - expected))
    return run.agg(F.lit(n).alias("n"), F.round(F.max(gap), 10).alias("statistic"))


BANDWIDTH, GRID = 10.0, list(range(0, 201, 10))


@query(
    "kde",
    f"""with g as (select unnest(generate_series(0, 200, 10))::double as x), v as (select value, count(*) as c from events group by 1), n as (select count(*) as n from events)
      select x, round(sum(c * exp(-(x - value) * (x - value) / (2 * {BANDWIDTH} * {BANDWIDTH}))) / any_value(n) / ({BANDWIDTH} * sqrt(2 * pi())), 10) as density
      from g, v, n group by x""",
)
def kde(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian kernel density on a fixed grid. Equal values are counted first; each remaining
    value meets the grid inside its own row and is summed before the shuffle."""
    ev = table(spark, d, "events")
    n = ev.count()
    values = ev.groupBy("value").agg(F.count("*").alias("c"))
    points = values.select("value", "c", F.explode(F.array(*[F.lit(float(x)) for x in GRID])).alias("x"))
    weight = F.col("c") * F.exp(-((F.col("x") - F.col("value")) ** 2) / (2 * BANDWIDTH**2))
    return points.groupBy("x").agg(F.round(F.sum(weight) / n / (BANDWIDTH * math.sqrt(2 * math.pi)), 10).alias("density"))


def gram(data: DataFrame) -> DataFrame:
    """``i, j, v`` of the product of the transposed table with itself: every task multiplies
    its own batches and sends one matrix, Spark adds the cells."""
    width = data.agg(F.max(F.size("x"))).first()[0]
    if width > MAX_GRAM_COLUMNS:
        raise ValueError("a dense column product needs a bounded number of columns")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = matrix(b["x"])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    return data.select("x").mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


@query(
    "gram_matrix",
    f"""with {CELLS_SQL} select a.j::int as i, b.j::int as j, round(sum(a.x * b.x), 7) as v from cells a join cells b using (vec_id) group by all""",
)
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return gram(samples(spark, d)).select("i", "j", F.round("v", 7).alias("v"))


@query(
    "column_cosine",
    f"""with {CELLS_SQL}, norms as (select j, sqrt(sum(x * x)) as n from cells group by 1)
      select a.j::int as i, b.j::int as j, round(sum(a.x * b.x) / any_value(na.n) / any_value(nb.n), 8) as cosine
      from cells a join cells b on a.vec_id = b.vec_id and a.j < b.j join norms na on na.j = a.j join norms nb on nb.j = b.j group by a.j, b.j""",
)
def column_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine similarity of every two columns, from the column products."""
    g = gram(samples(spark, d))
    norms = g.filter("i = j").select("i", F.sqrt("v").alias("n"))
    return (
        g.filter("i < j").join(norms, "i").join(norms.select(F.col("i").alias("j"), F.col("n").alias("m")), "j")
        .select("i", "j", F.round(F.col("v") / F.col("n") / F.col("m"), 8).alias("cosine")))


@query("gram_svd")
def gram_svd(spark: SparkSession, d: str) -> DataFrame:
    """Singular values of the tall table and explained variance of its principal components,
    from the small product matrix."""
    data = samples(spark, d)
    cells = gram(data).collect()
    k = max(r["i"] for r in cells) + 1
    g = np.zeros((k, k))
    for r in cells:
        g[r["i"], r["j"]] = r["v"]
    mean = data.agg(Summarizer.mean(array_to_vector("x"))).first()[0].toArray()
    n = data.count()
    cov = (g - n * np.outer(mean, mean)) / (n - 1)
    sv = np.sqrt(np.clip(np.linalg.eigvalsh(g)[::-1], 0, None))
    ev = np.linalg.eigvalsh(cov)[::-1]
    return spark.createDataFrame([(i + 1, float(s), float(e / ev.sum())) for i, (s, e) in enumerate(zip(sv, ev))],
                                 "component int, singular_value double, explained double")


_SCORED_SQL = """p as (select d.doc_id, n_chars as score, quality as label from documents d join labels l on d.doc_id = l.doc_id)"""


@query(
    "metrics_binary",
    f"""with {_SCORED_SQL}, r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as mid from p),
      a as (select count_if(label = 1) as pos, count_if(label = 0) as neg, sum(mid) filter (label = 1) as s from r),
      t as (select count_if(score > 1000 and label = 1) as tp, count_if(score > 1000 and label = 0) as fp, count_if(score <= 1000 and label = 1) as fn from p)
      select pos, neg, round((s - pos * (pos + 1) / 2.0) / (pos * neg), 9)::double as auc, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall,
        round(2 * tp / (2 * tp + fp + fn), 9) as f1 from a, t""",
)
def metrics_binary(spark: SparkSession, d: str) -> DataFrame:
    """Area under the ROC curve by rank sum over score counts, and metrics at one threshold."""
    p = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score")).join(
        table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    by_score = p.groupBy("score").agg(F.count("*").alias("c"), F.count_if(F.col("label") == 1).alias("pos"))
    run = prefix(by_score, [], ["score"], {"upto": ("sum", "c")})
    mid = F.col("upto") - (F.col("c") - 1) / 2
    tall = F.col("score") > 1000
    a = run.agg(F.sum("pos").alias("pos"), F.sum(F.col("c") - F.col("pos")).alias("neg"), F.sum(F.col("pos") * mid).alias("s"),
                F.sum(F.when(tall, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(tall, F.col("c") - F.col("pos")).otherwise(0)).alias("fp"))
    fn = F.col("pos") - F.col("tp")
    return a.select(
        "pos", "neg", F.round((F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg")), 9).alias("auc"),
        F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.col("tp") / F.col("pos"), 9).alias("recall"),
        F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + fn), 9).alias("f1"))


@query(
    "metrics_multiclass",
    f"""with {CELLS_SQL}, preds as (select vec_id, any_value(label) as label, arg_max(k, logit) as prediction from scores group by vec_id),
      m as (select label, prediction, count(*) as n from preds group by all), classes as (select distinct label as c from preds union select distinct prediction from preds)
      select c as label, coalesce(sum(n) filter (label = c and prediction = c), 0)::bigint as tp, coalesce(sum(n) filter (label = c), 0)::bigint as actual, coalesce(sum(n) filter (prediction = c), 0)::bigint as predicted,
        round(coalesce(sum(n) filter (label = c and prediction = c), 0) / nullif(sum(n) filter (prediction = c), 0), 9) as precision,
        round(coalesce(sum(n) filter (label = c and prediction = c), 0) / nullif(sum(n) filter (label = c), 0), 9) as recall,
        round(2 * coalesce(sum(n) filter (label = c and prediction = c), 0) / (coalesce(sum(n) filter (label = c), 0) + coalesce(sum(n) filter (prediction = c), 0)), 9) as f1
      from classes, m group by c""",
)
def metrics_multiclass(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 per class: each row adds to its own and its predicted class."""
    preds = with_logits(spark, d).select("label", top1().alias("prediction"))
    hit = (F.col("label") == F.col("prediction")).cast("bigint")
    cells = preds.groupBy("label", "prediction").agg(F.count("*").alias("n")).select(F.inline(F.array(
        F.struct(F.col("label").alias("c"), (F.col("n") * hit).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted")))))
    t = cells.groupBy(F.col("c").alias("label")).agg(F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
    return t.select("label", "tp", "actual", "predicted", F.round(F.try_divide("tp", "predicted"), 9).alias("precision"), F.round(F.try_divide("tp", "actual"), 9).alias("recall"),
                    F.round(2 * F.col("tp") / (F.col("actual") + F.col("predicted")), 9).alias("f1"))


@query(
    "metrics_multilabel",
    """with s as (select l_orderkey, list(distinct l_returnflag) filter (l_quantity > 25) as p, list(distinct l_returnflag) filter (l_discount > 0.05) as a from lineitem group by 1),
         t as (select coalesce(p, []) as p, coalesce(a, []) as a from s), u as (select len(p) as np, len(a) as na, len(list_intersect(p, a)) as shared from t)
       select count(*) as n, round(avg(case when np + na - shared = 0 then 0 else shared / (np + na - shared) end), 9) as jaccard, round(avg(case when np > 0 then shared / np else 0 end), 9) as precision,
         round(avg(case when na > 0 then shared / na else 0 end), 9) as recall, round(avg((np - shared + na - shared) / 3.0), 9) as hamming, round(sum(shared) / sum(np), 9) as micro_precision from u""",
)
def metrics_multilabel(spark: SparkSession, d: str) -> DataFrame:
    """Predicted against actual label sets of an order; a set has at most three labels."""
    flag = F.col("l_returnflag")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_quantity") > 25, flag)).alias("p"), F.collect_set(F.when(F.col("l_discount") > 0.05, flag)).alias("a"))
    u = s.select(F.size("p").alias("np"), F.size("a").alias("na"), F.size(F.array_intersect("p", "a")).alias("both"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    b, p, a = F.col("both"), F.col("np"), F.col("na")
    return u.agg(F.count("*").alias("n"), F.round(F.avg(share(b, p + a - b)), 9).alias("jaccard"), F.round(F.avg(share(b, p)), 9).alias("precision"),
                 F.round(F.avg(share(b, a)), 9).alias("recall"), F.round(F.avg((p - b + a - b) / 3), 9).alias("hamming"),
                 F.round(F.sum("both") / F.sum("np"), 9).alias("micro_precision"))


@query(
    "metrics_ranking",
    f"""with r as (select user_id, event_id, (event_type = 'purchase')::int as rel, row_number() over w as pos, sum((event_type = 'purchase')::int) over w as hits
          from events window w as (partition by user_id order by value desc, event_id)),
        u as (select user_id, sum(rel) filter (pos <= {TOP}) / {TOP}.0 as p_at, coalesce(sum(rel * hits / pos) / nullif(sum(rel), 0), 0) as ap,
              coalesce(sum(rel / ln(pos + 1)) filter (pos <= {TOP}), 0) as dcg, sum(rel) as n_rel from r group by 1),
        i as (select user_id, case when n_rel = 0 then 0 else (select sum(1 / ln(g + 1)) from generate_series(1, {TOP}) t(g) where g <= n_rel) end as ideal from u)
      select count(*) as n_users, round(avg(p_at), 8)::double as precision_at, round(avg(ap), 8) as mean_average_precision, round(avg(case when ideal = 0 then 0 else dcg / ideal end), 8) as ndcg_at
      from u join i using (user_id)""",
)
def metrics_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user ranked by value; purchases are the relevant ones."""
    ev = table(spark, d, "events").select("user_id", "event_id", (-F.col("value")).alias("neg"), (F.col("event_type") == "purchase").cast("int").alias("rel"))
    r = prefix(ev.withColumn("one", F.lit(1)), ["user_id"], ["neg", "event_id"], {"pos": ("count", "one"), "hits": ("sum", "rel")})
    near = F.col("pos") <= TOP
    u = r.groupBy("user_id").agg(
        (F.sum(F.when(near, F.col("rel")).otherwise(0)) / TOP).alias("p_at"), F.sum(F.col("rel") * F.col("hits") / F.col("pos")).alias("s"),
        F.sum("rel").alias("n_rel"), F.sum(F.when(near, F.col("rel") / F.log(F.col("pos") + 1)).otherwise(0.0)).alias("dcg"))
    gains = F.array(*[F.lit(1 / math.log(g + 1)) for g in range(1, TOP + 1)])
    ideal = F.aggregate(F.slice(gains, F.lit(1), F.least(F.col("n_rel"), F.lit(TOP)).cast("int")), F.lit(0.0), lambda s, v: s + v)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return u.agg(F.count("*").alias("n_users"), F.round(F.avg("p_at"), 8).alias("precision_at"), F.round(F.avg(share(F.col("s"), F.col("n_rel"))), 8).alias("mean_average_precision"),
                 F.round(F.avg(share(F.col("dcg"), ideal)), 8).alias("ndcg_at"))


@query(
    "metrics_regression",
    """with p as (select l_extendedprice as y, l_quantity * 2000 as f from lineitem), m as (select avg(y) as my from p)
       select round(sqrt(avg((y - f) * (y - f))), 5) as rmse, round(avg((y - f) * (y - f)), 1) as mse, round(avg(abs(y - f)), 5) as mae,
         round(1 - sum((y - f) * (y - f)) / sum((y - my) * (y - my)), 9) as r2, round(avg((f - my) * (f - my)), 1) as explained_variance from p, m""",
)
def metrics_regression(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("f"))
    mean = p.agg(F.avg("y")).first()[0]
    err = F.col("y") - F.col("f")
    return p.agg(F.round(F.sqrt(F.avg(err * err)), 5).alias("rmse"), F.round(F.avg(err * err), 1).alias("mse"), F.round(F.avg(F.abs(err)), 5).alias("mae"),
                 F.round(1 - F.sum(err * err) / F.sum((F.col("y") - mean) ** 2), 9).alias("r2"), F.round(F.avg((F.col("f") - mean) ** 2), 1).alias("explained_variance"))


_FLOW_SQL = """flow as (select c_nationkey as i, s_nationkey as j, sum(l_quantity) as v from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all)"""


def flow(spark: SparkSession, d: str) -> DataFrame:
    """Quantity that customers of nation ``i`` bought from suppliers of nation ``j``."""
    li, o, c, s = tables(spark, d, "lineitem", "orders", "customer", "supplier")
    buyers = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_nationkey").alias("i"))
    sellers = s.select("s_suppkey", F.col("s_nationkey").alias("j"))
    return li.join(buyers, li.l_orderkey == buyers.o_orderkey).join(sellers, li.l_suppkey == sellers.s_suppkey).groupBy("i", "j").agg(F.sum("l_quantity").alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two coordinate matrices: join on the inner index, sum the products."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


@query("matmul", f"with {_FLOW_SQL} select a.i, b.i as j, round(sum(a.v * b.v), 2) as v from flow a join flow b on a.j = b.j group by all")
def matmul(spark: SparkSession, d: str) -> DataFrame:
    """The flow matrix times its own transpose."""
    f = flow(spark, d)
    return multiply(f, transposed(f)).select("i", "j", F.round("v", 2).alias("v"))


@query(
    "matrix_add",
    f"with {_FLOW_SQL} select i, j, round(sum(v), 2) as v from (select i, j, v from flow union all select j, i, v from flow) group by all",
)
def matrix_add(spark: SparkSession, d: str) -> DataFrame:
    """The flow matrix plus its transpose: trade in both directions."""
    f = flow(spark, d)
    return added(f, transposed(f)).select("i", "j", F.round("v", 2).alias("v"))
