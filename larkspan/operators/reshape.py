"""Cleaning and reshaping: nulls, gaps, imputation, dummies, stacking, resampling, calendars."""

from __future__ import annotations

from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.skew import drop_halo, micros, percentiles, positions, prefix, ranks, with_halo
from larkspan.registry import query
from larkspan.sources.tables import table, tables

HOUR = 3_600_000_000
MAX_DUMMY_COLUMNS = 1_000


@query(
    "null_clean",
    """with t as (select d.doc_id, case when lang = 'en' then 'english' else lang end as lang, quality, toxic
                  from documents d left join labels l on d.doc_id = l.doc_id)
       select doc_id, lang, coalesce(quality, -1) as quality, coalesce(toxic, -1) as toxic, quality is not null as labelled from t""",
)
def null_clean(spark: SparkSession, d: str) -> DataFrame:
    """Left join leaves nulls: count them, fill them, replace values."""
    docs, labels = tables(spark, d, "documents", "labels")
    joined = docs.select("doc_id", "lang").join(labels, "doc_id", "left")
    return (
        joined.withColumn("labelled", F.col("quality").isNotNull())
        .fillna({"quality": -1, "toxic": -1}).replace({"en": "english"}, subset=["lang"])
        .select("doc_id", "lang", "quality", "toxic", "labelled"))


@query(
    "null_drop",
    """with t as (select d.doc_id, lang, quality, case when toxic = 0 then null else toxic end as toxic
                  from documents d left join labels l on d.doc_id = l.doc_id)
       select 'any' as rule, count(*) as n from t where quality is not null and toxic is not null
       union all select 'all', count(*) from t where quality is not null or toxic is not null
       union all select 'thresh', count(*) from t
         where (quality is not null)::int + (toxic is not null)::int + (lang is not null)::int >= 2""",
)
def null_drop(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = tables(spark, d, "documents", "labels")
    t = docs.select("doc_id", "lang").join(
        labels.withColumn("toxic", F.nullif(F.col("toxic"), F.lit(0))), "doc_id", "left")
    rules = {
        "any": t.dropna("any", subset=["quality", "toxic"]),
        "all": t.na.drop("all", subset=["quality", "toxic"]),
        "thresh": t.dropna(thresh=2, subset=["quality", "toxic", "lang"]),
    }
    out = None
    for rule, kept in rules.items():
        one = kept.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "fill_gaps",
    """with p as (select event_id, user_id, ts, epoch_us(ts) as t, case when event_type = 'error' then null else value end as v from events),
            q as (select *, last_value(v ignore nulls) over b as pv, last_value(case when v is not null then t end ignore nulls) over b as pt,
                         first_value(v ignore nulls) over f as nv, first_value(case when v is not null then t end ignore nulls) over f as nt
                  from p window b as (partition by user_id order by t, event_id rows between unbounded preceding and current row),
                                f as (partition by user_id order by t, event_id rows between current row and unbounded following))
       select event_id, pv as ffilled, nv as bfilled,
              round(case when v is not null then v when pv is not null and nv is not null
                         then pv + (nv - pv) * (t - pt) / (nt - pt) end, 6) as interpolated
       from q""",
)
def fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Forward fill, backward fill and linear interpolation in time of missing readings."""
    ev = table(spark, d, "events").select(
        "event_id", "user_id", micros("ts").alias("t"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    ev = ev.withColumn("known", F.when(F.col("v").isNotNull(), F.struct("v", "t")))
    ev = prefix(ev, ["user_id"], ["t", "event_id"], {"prev": ("last", "known")})
    ev = ev.withColumns({"rt": -F.col("t"), "rid": -F.col("event_id")})
    ev = prefix(ev, ["user_id"], ["rt", "rid"], {"next": ("last", "known")})
    slope = (F.col("next.v") - F.col("prev.v")) * (F.col("t") - F.col("prev.t")) / (F.col("next.t") - F.col("prev.t"))
    return ev.select(
        "event_id", F.col("prev.v").alias("ffilled"), F.col("next.v").alias("bfilled"),
        F.round(F.when(F.col("v").isNotNull(), F.col("v")).when(
            F.col("prev").isNotNull() & F.col("next").isNotNull(), F.col("prev.v") + slope), 6).alias("interpolated"))


@query(
    "impute",
    """with t as (select s_suppkey, case when s_acctbal < 0 then null else s_acctbal end as bal,
                         case when s_nationkey < 3 then null else s_nationkey end as nat from supplier),
            m as (select avg(bal) as mean_bal, quantile_cont(bal, 0.5) as med, (select nat from t where nat is not null group by nat
                  order by count(*) desc, nat limit 1) as mode_nat from t)
       select s_suppkey, round(coalesce(bal, mean_bal), 4) as by_mean, round(coalesce(bal, med), 4) as by_median,
              coalesce(nat, mode_nat)::double as by_mode from t, m""",
)
def impute(spark: SparkSession, d: str) -> DataFrame:
    """Missing values replaced by mean, exact median and mode."""
    t = table(spark, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("bal"),
        F.when(F.col("s_nationkey") >= 3, F.col("s_nationkey").cast("double")).alias("nat"))
    median = percentiles(t, [], "bal", {"med": 0.5}).first()["med"]
    by_mean = Imputer(strategy="mean", inputCols=["bal"], outputCols=["by_mean"], missingValue=float("nan")).fit(t)
    by_mode = Imputer(strategy="mode", inputCols=["nat"], outputCols=["by_mode"], missingValue=float("nan")).fit(t)
    done = by_mode.transform(by_mean.transform(t))
    return done.select(
        "s_suppkey", F.round("by_mean", 4).alias("by_mean"), F.round(F.coalesce("bal", F.lit(median)), 4).alias("by_median"),
        "by_mode")


@query(
    "clip_mask",
    """select c_custkey, least(greatest(c_acctbal, 0), 5000) as clipped, case when c_acctbal > 0 then c_acctbal end as kept,
              case when c_acctbal > 0 then -1.0 else c_acctbal end as masked, c_nationkey in (1, 3, 5) as in_set from customer""",
)
def clip_mask(spark: SparkSession, d: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", F.least(F.greatest(bal, F.lit(0.0)), F.lit(5000.0)).alias("clipped"), F.when(bal > 0, bal).alias("kept"),
        F.when(bal > 0, -1.0).otherwise(bal).alias("masked"), F.col("c_nationkey").isin(1, 3, 5).alias("in_set"))


@query(
    "dummies",
    """select p_partkey, (p_type = 'ECONOMY')::int as type_ECONOMY, (p_type = 'LARGE')::int as type_LARGE,
              (p_type = 'MEDIUM')::int as type_MEDIUM, (p_type = 'PROMO')::int as type_PROMO, (p_type = 'SMALL')::int as type_SMALL,
              (p_type = 'STANDARD')::int as type_STANDARD, dense_rank() over (order by p_brand) - 1 as brand_code from part""",
)
def dummies(spark: SparkSession, d: str) -> DataFrame:
    """One 0/1 column per category and an integer code per brand. The code table holds one row
    per distinct brand; only that table is numbered."""
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    distinct = p.select("p_type").distinct()
    if distinct.count() > MAX_DUMMY_COLUMNS:
        raise ValueError("too many categories for one column each; use the integer code")
    kinds = [r[0] for r in distinct.orderBy("p_type").collect()]
    brands = positions(p.select("p_brand").distinct(), [], ["p_brand"])
    codes = brands.select("p_brand", (F.col("row_pos") - 1).alias("brand_code"))
    return p.join(codes, "p_brand").select(
        "p_partkey", *[(F.col("p_type") == k).cast("int").alias(f"type_{k}") for k in kinds], "brand_code")


@query(
    "reshape",
    """with m as (select l_suppkey, l_returnflag, sum(l_quantity) as q, count(*) as n from lineitem group by all),
            w as (select l_suppkey, sum(q) filter (l_returnflag = 'A') as A, sum(q) filter (l_returnflag = 'N') as N,
                         sum(q) filter (l_returnflag = 'R') as R from m group by 1)
       select l_suppkey, returnflag, round(qty, 2) as qty, round(qty / (coalesce(A, 0) + coalesce(N, 0) + coalesce(R, 0)), 8) as share
       from (select *, A as a1, N as n1, R as r1 from w) unpivot (qty for returnflag in (a1 as 'A', n1 as 'N', r1 as 'R'))""",
)
def reshape(spark: SparkSession, d: str) -> DataFrame:
    """Pivot table (unstack) to one row per supplier, then stacked back to long form."""
    wide = (
        table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")))
    total = F.coalesce("A", F.lit(0.0)) + F.coalesce("N", F.lit(0.0)) + F.coalesce("R", F.lit(0.0))
    long = wide.withColumn("total", total).select(
        "l_suppkey", "total", F.stack(F.lit(3), F.lit("A"), "A", F.lit("N"), "N", F.lit("R"), "R").alias("returnflag", "qty"))
    return long.filter("qty is not null").select(
        "l_suppkey", "returnflag", F.round("qty", 2).alias("qty"), F.round(F.col("qty") / F.col("total"), 8).alias("share"))


@query(
    "transpose",
    """select metric, max(v) filter (s = 'F') as F, max(v) filter (s = 'O') as O, max(v) filter (s = 'P') as P from (
         select o_orderstatus as s, unnest(['n', 'total', 'top']) as metric,
                unnest([count(*)::double, round(sum(o_totalprice), 2), max(o_totalprice)]) as v from orders group by 1) group by 1""",
)
def transpose(spark: SparkSession, d: str) -> DataFrame:
    """Rows to columns and columns to rows of an aggregated table."""
    agg = table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count("*").cast("double").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("top"))
    return (
        agg.unpivot("o_orderstatus", ["n", "total", "top"], "metric", "v")
        .groupBy("metric").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("v")))


@query(
    "resample",
    """with cal as (select unnest(generate_series(date_trunc('day', (select min(ts) from events)),
                                                date_trunc('day', (select max(ts) from events)), interval 6 hour)) as bucket),
            agg as (select time_bucket(interval 6 hour, ts, timestamp '2000-01-01') as bucket, count(*) as n, sum(value) as total, min(value) as low,
                           max(value) as high, avg(value) as mean, stddev_samp(value) as sd from events where event_type = 'purchase' group by 1)
       select cal.bucket, coalesce(n, 0) as n, round(coalesce(total, 0), 2) as total, low, high, round(mean, 6) as mean, round(sd, 6) as sd
       from cal left join agg on cal.bucket = agg.bucket""",
)
def resample(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour buckets, with the empty ones present."""
    ev = table(spark, d, "events")
    width = 6 * HOUR
    span = ev.agg(F.min(F.floor(micros(F.date_trunc("day", F.col("ts").cast("date").cast("timestamp_ntz"))) / width)).alias("a"),
                  F.max(F.floor(micros(F.date_trunc("day", F.col("ts").cast("date").cast("timestamp_ntz"))) / width)).alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("slot"))
    sums = (
        ev.filter("event_type = 'purchase'").groupBy(F.floor(micros("ts") / width).alias("slot"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
             F.avg("value").alias("mean"), F.stddev("value").alias("sd")))
    start = F.timestamp_micros((F.col("slot") * width).cast("bigint")).cast("timestamp_ntz")
    return calendar.join(sums, "slot", "left").select(
        start.alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"),
        "low", "high", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(
    "series_ops",
    """with day as (select cast(o_orderdate as date) as day, sum(o_totalprice) as v from orders group by 1),
            s as (select day, v, lag(v) over w as p, lag(v, 7) over w as p7, rank() over (order by round(v, 2) desc) as place from day window w as (order by day))
       select day, round(v, 2) as total, round((v - p) / p, 8) as pct_change, round(v - p7, 2) as diff7, place,
              (select round(corr(v, p), 6) from s) as autocorr1, (select round(quantile_cont(v, 0.9), 4) from day) as q90
       from s""",
)
def series_ops(spark: SparkSession, d: str) -> DataFrame:
    """Percent change, seasonal difference, rank, quantile and autocorrelation of the daily series."""
    day = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    day = positions(day, [], ["day"]).withColumn("neg", -F.round("v", 2))
    w = Window.partitionBy("__block").orderBy("row_pos")
    s = drop_halo(
        with_halo(day, F.col("row_pos"), before=7, after=0, block=1_000_000)
        .withColumn("p", F.lag("v").over(w)).withColumn("p7", F.lag("v", 7).over(w)))
    auto = s.agg(F.round(F.corr("v", "p"), 6)).first()[0]
    q90 = percentiles(day, [], "v", {"q": 0.9}).first()["q"]
    place = ranks(day.select("day", "neg"), [], "neg", ["day"]).select("day", F.col("rank").alias("place"))
    return s.join(place, "day").select(
        "day", F.round("v", 2).alias("total"), F.round((F.col("v") - F.col("p")) / F.col("p"), 8).alias("pct_change"),
        F.round(F.col("v") - F.col("p7"), 2).alias("diff7"), "place", F.lit(auto).alias("autocorr1"),
        F.lit(round(q90, 4)).alias("q90"))


@query(
    "calendar",
    """with b as (select min(o_orderdate) as a, max(o_orderdate) as z from orders),
            cal as (select unnest(generate_series(a, z, interval 1 day))::date as day from b)
       select cal.day, isodow(cal.day)::int as iso_dow, isodow(cal.day) in (6, 7) as weekend, last_day(cal.day) as month_end,
              quarter(cal.day)::int as quarter, count(o_orderkey) as n_orders,
              count(*) filter (try_cast(substr(o_orderpriority, 1, 1) as int) = 1) as n_urgent
       from cal left join orders on cal.day = cast(o_orderdate as date) group by cal.day""",
)
def calendar(spark: SparkSession, d: str) -> DataFrame:
    """One row per day from the first to the last order, orders or not."""
    o = table(spark, d, "orders")
    span = o.agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("z"))
    days = span.select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("day"))
    per_day = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("n_orders"),
        F.count_if(F.substring("o_orderpriority", 1, 1).try_cast("int") == 1).alias("n_urgent"))
    return days.join(per_day, "day", "left").select(
        "day", (F.weekday("day") + 1).alias("iso_dow"), F.weekday("day").isin(5, 6).alias("weekend"),
        F.last_day("day").alias("month_end"), F.quarter("day").alias("quarter"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_urgent", F.lit(0)).alias("n_urgent"))
