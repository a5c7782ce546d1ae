"""Window functions: running, range and moving frames, ranks, offsets, rolling and weighted means.

Every job splits hot keys through the helpers in ``skew``: running values carry totals from
piece to piece, bounded frames work on blocks with a copied border.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.frames import expanding_quantiles, range_frames, rolling_moments, rolling_quantiles
from larkspan.operators.skew import drop_halo, micros, ntile, null_safe_join, positions, prefix, ranks, with_halo
from larkspan.registry import query
from larkspan.sources.tables import table

BLOCK_ROWS = 1_000_000


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts", "value")


@query(
    "win_running",
    """select o_orderkey, o_custkey, round(sum(o_totalprice) over w, 2) as running_total, count(*) over w as nth,
              max(o_totalprice) over w as best_so_far
       from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)""",
)
def win_running(spark: SparkSession, d: str) -> DataFrame:
    run = prefix(
        table(spark, d, "orders").withColumn("one", F.lit(1)), ["o_custkey"], ["o_orderdate", "o_orderkey"],
        {"running_total": ("sum", "o_totalprice"), "nth": ("count", "one"), "best_so_far": ("max", "o_totalprice")})
    return run.select("o_orderkey", "o_custkey", F.round("running_total", 2).alias("running_total"), "nth", "best_so_far")


@query(
    "win_range",
    """select event_id, count(*) over w as n_last_day, round(sum(value) over w, 2) as sum_last_day
       from events window w as (partition by user_id order by ts range between interval 1 day preceding and current row)""",
)
def win_range(spark: SparkSession, d: str) -> DataFrame:
    """Count and sum over the last 24 hours of each user."""
    ev = _history(spark, d).withColumn("t", micros("ts"))
    out = range_frames(ev, ["user_id"], "t", "value", "event_id", before=86_400_000_000)
    return out.select("event_id", F.col("n_rows").alias("n_last_day"), F.round("total", 2).alias("sum_last_day"))


@query(
    "win_range_extremes",
    """select event_id, count(value) over w as n, round(sum(value) over w, 2) as total, min(value) over w as least, max(value) over w as most
       from events window w as (partition by event_type order by ts range between interval 2 days preceding and interval 6 hours following)""",
)
def win_range_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Count, sum and extremes of an event type from two days before an event to six hours after it: few keys, each of them hot."""
    ev = table(spark, d, "events").select("event_id", "event_type", "value", micros("ts").alias("t"))
    out = range_frames(ev, ["event_type"], "t", "value", "event_id", before=2 * 86_400_000_000, after=6 * 3_600_000_000)
    return out.select("event_id", "n", F.round("total", 2).alias("total"), "least", "most")


@query(
    "rolling_quantile",
    """select event_id, case when count(value) over w >= 5 then round(quantile_cont(value, 0.5) over w, 6) end as median,
              case when count(value) over w >= 5 then round(quantile_cont(value, 0.9) over w, 6) end as p90
       from events window w as (partition by user_id order by ts, event_id rows between 19 preceding and current row)""",
)
def rolling_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Median and 90th percentile of a user's last twenty events, from five values on."""
    out = rolling_quantiles(_history(spark, d), ["user_id"], ["ts", "event_id"], "value", 20, {"median": 0.5, "p90": 0.9}, 5, BLOCK_ROWS)
    return out.select("event_id", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


@query(
    "expanding_quantile",
    """select event_id, round(quantile_cont(value, 0.25) over w, 6) as q1, round(quantile_cont(value, 0.5) over w, 6) as median,
              round(quantile_cont(value, 0.95) over w, 6) as p95
       from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
)
def expanding_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of all events of a user so far."""
    out = expanding_quantiles(_history(spark, d), ["user_id"], ["ts", "event_id"], "value", {"q1": 0.25, "median": 0.5, "p95": 0.95})
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("q1", "median", "p95")])


@query(
    "rolling_moments",
    """select event_id, case when count(value) over w >= 3 and max(value) over w > min(value) over w then round(skewness(value) over w, 5) end as skew,
              case when count(value) over w >= 4 and max(value) over w > min(value) over w then round(kurtosis(value) over w, 5) end as kurt
       from events window w as (partition by user_id order by ts, event_id rows between 19 preceding and current row)""",
)
def rolling_shape(spark: SparkSession, d: str) -> DataFrame:
    """Skewness and excess kurtosis of a user's last twenty events."""
    out = rolling_moments(_history(spark, d), ["user_id"], ["ts", "event_id"], "value", 20, BLOCK_ROWS)
    return out.select("event_id", F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"))


@query(
    "win_rank",
    """select c_custkey, c_nationkey, row_number() over (w, c_custkey) as row_number, rank() over w as rank,
              dense_rank() over w as dense_rank, round(percent_rank() over w, 9) as percent_rank,
              round(cume_dist() over w, 9) as cume_dist, cast(ntile(4) over (w, c_custkey) as int) as quartile
       from (select c_custkey, c_nationkey, floor(c_acctbal / 100) as b from customer)
       window w as (partition by c_nationkey order by b)""".replace("over (w, c_custkey)", "over (partition by c_nationkey order by b, c_custkey)"),
)
def win_rank(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 100).alias("b"))
    r = ranks(c, ["c_nationkey"], "b", ["c_custkey"])
    return r.select(
        "c_custkey", "c_nationkey", "row_number", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"),
        F.round("cume_dist", 9).alias("cume_dist"), ntile(F.col("row_number"), F.col("group_rows"), 4).alias("quartile"))


@query(
    "win_lag_lead",
    """select event_id, lag(value) over w as prev_value, lead(value, 2, -1.0) over w as next2_value,
              first_value(event_id) over g as first_event, last_value(event_id) over g as last_event,
              nth_value(event_id, 2) over g as second_event
       from events window w as (partition by user_id order by ts, event_id),
            g as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)""",
)
def win_lag_lead(spark: SparkSession, d: str) -> DataFrame:
    ev = positions(_history(spark, d), ["user_id"], ["ts", "event_id"])
    w = Window.partitionBy("user_id", "__block").orderBy("row_pos")
    moved = drop_halo(
        with_halo(ev, F.col("row_pos"), before=1, after=2, block=BLOCK_ROWS)
        .withColumn("prev_value", F.lag("value").over(w)).withColumn("next2_value", F.lead("value", 2, -1.0).over(w)))
    ends = ev.groupBy("user_id").agg(
        F.min_by("event_id", "row_pos").alias("first_event"), F.max_by("event_id", "row_pos").alias("last_event"),
        F.max(F.when(F.col("row_pos") == 2, F.col("event_id"))).alias("second_event"))
    return moved.join(ends, "user_id").select(
        "event_id", "prev_value", "next2_value", "first_event", "last_event", "second_event")


@query(
    "win_moving_avg",
    """select event_id, round(avg(value) over w, 6) as avg5, count(*) over w as n5, min(value) over w as min5,
              max(value) over w as max5
       from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)""",
)
def win_moving_avg(spark: SparkSession, d: str) -> DataFrame:
    ev = positions(_history(spark, d), ["user_id"], ["ts", "event_id"])
    w = Window.partitionBy("user_id", "__block").orderBy("row_pos").rowsBetween(-2, 2)
    return drop_halo(
        with_halo(ev, F.col("row_pos"), before=2, after=2, block=BLOCK_ROWS).select(
            "event_id", "__home", "__block", F.round(F.avg("value").over(w), 6).alias("avg5"),
            F.count("*").over(w).alias("n5"), F.min("value").over(w).alias("min5"), F.max("value").over(w).alias("max5")))


@query(
    "win_native",
    """select l_orderkey, l_linenumber, l_extendedprice, l_partkey,
              rank() over w as price_rank, dense_rank() over w as price_dense,
              round(sum(l_extendedprice) over (partition by l_orderkey), 2) as order_total,
              round(l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey), 8) as share
       from lineitem window w as (partition by l_orderkey order by l_extendedprice desc)""",
)
def win_native(spark: SparkSession, d: str) -> DataFrame:
    """Ranks and shares inside an order, by the split forms: an order may be too large for one task."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    totals = li.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    placed = ranks(li.withColumn("neg", -F.col("l_extendedprice")), ["l_orderkey"], "neg", ["l_linenumber", "l_partkey"])
    placed = placed.withColumn("price_dense", F.col("dense_rank").cast("int")).withColumn("price_rank", F.col("rank").cast("int"))
    placed = null_safe_join(placed, totals, ["l_orderkey"])
    return placed.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "price_rank", "price_dense",
                         F.round("total", 2).alias("order_total"), F.round(F.col("l_extendedprice") / F.col("total"), 8).alias("share"))


@query(
    "rolling_stats",
    """select event_id, case when count(*) over w = 4 then round(avg(value) over w, 6) end as roll_mean,
              case when count(*) over w = 4 then round(stddev_samp(value) over w, 6) end as roll_std,
              case when count(*) over w = 4 then max(value) over w end as roll_max,
              round(avg(value) over e, 9) as exp_mean, max(value) over e as exp_max, count(*) over e as exp_count
       from events window w as (partition by user_id order by ts, event_id rows between 3 preceding and current row),
            e as (partition by user_id order by ts, event_id rows unbounded preceding)""",
)
def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rolling frame of four rows (null until full) and the expanding frame."""
    ev = prefix(_history(spark, d).withColumn("one", F.lit(1)), ["user_id"], ["ts", "event_id"],
                {"row_pos": ("count", "one"), "s": ("sum", "value"), "exp_max": ("max", "value")})
    w = Window.partitionBy("user_id", "__block").orderBy("row_pos").rowsBetween(-3, 0)
    full = F.col("row_pos") >= 4
    return drop_halo(
        with_halo(ev, F.col("row_pos"), before=3, after=0, block=BLOCK_ROWS).select(
            "event_id", "__home", "__block",
            F.when(full, F.round(F.avg("value").over(w), 6)).alias("roll_mean"),
            F.when(full, F.round(F.stddev("value").over(w), 6)).alias("roll_std"),
            F.when(full, F.max("value").over(w)).alias("roll_max"),
            F.round(F.col("s") / F.col("row_pos"), 9).alias("exp_mean"), "exp_max", F.col("row_pos").alias("exp_count")))


@query(
    "ewm_mean",
    """with p as (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events)
       select event_id, round(sum(value * pow(2.0, i)) over w / sum(pow(2.0, i)) over w, 6) as ewm
       from p window w as (partition by user_id order by i rows unbounded preceding)""",
)
def ewm_mean(spark: SparkSession, d: str) -> DataFrame:
    """Exponentially weighted mean with alpha 0.5. Weights halve per row, so 63 rows back they
    are below double precision: that frame is the whole sum."""
    reach = 63
    ev = positions(_history(spark, d), ["user_id"], ["ts", "event_id"])
    w = Window.partitionBy("user_id", "__block").orderBy("row_pos").rowsBetween(-reach, 0)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    mean = F.aggregate(
        F.collect_list("value").over(w), zero,
        lambda a, x: F.struct((a.s * 0.5 + x).alias("s"), (a.w * 0.5 + 1).alias("w")), lambda a: a.s / a.w)
    return drop_halo(
        with_halo(ev, F.col("row_pos"), before=reach, after=0, block=BLOCK_ROWS)
        .select("event_id", "__home", "__block", F.round(mean, 6).alias("ewm")))


@query(
    "win_pandas_udf",
    """select event_id, round(avg(value) over w, 6) as mean3, max(value) over w - min(value) over w as spread3
       from events window w as (partition by user_id order by ts, event_id rows between 1 preceding and 1 following)"""
    .replace("max(value) over w - min(value) over w", "round(max(value) over w - min(value) over w, 2)"),
)
def win_pandas_udf(spark: SparkSession, d: str) -> DataFrame:
    """Grouped-aggregate pandas functions over a bounded frame; the block keeps every window
    group small enough for one Arrow batch."""

    @F.pandas_udf("double")
    def mean(v: pd.Series) -> float:
        return v.mean()

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return v.max() - v.min()

    ev = positions(_history(spark, d), ["user_id"], ["ts", "event_id"])
    w = Window.partitionBy("user_id", "__block").orderBy("row_pos").rowsBetween(-1, 1)
    return drop_halo(
        with_halo(ev, F.col("row_pos"), before=1, after=1, block=100_000)
        .select("event_id", "__home", "__block", F.round(mean("value").over(w), 6).alias("mean3"),
                F.round(spread("value").over(w), 2).alias("spread3")))
