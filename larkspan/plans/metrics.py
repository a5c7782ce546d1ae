"""Metric time series of a run: summaries, counters, balance, snapshots, checkpoints, latency.

Events stand in for the samples a monitor takes: the user is the monitored entity, the value
the reading, the time the sampling time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.skew import drop_halo, micros, percentiles, positions, prefix, with_halo
from larkspan.registry import query
from larkspan.sources.tables import table

# Fixed value: shortest duration counted, in seconds.
MIN_DURATION = 0.001


def readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("entity"), "event_type", micros("ts").alias("t"), "value")


@query(
    "metric_summary",
    """select user_id as entity, count(*) as num_samples, min(value) as low, max(value) as high, round(avg(value), 9) as mean,
         arg_min(value, (ts, event_id)) as first, arg_max(value, (ts, event_id)) as final,
         round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 2) as delta,
         arg_max(value, (ts, event_id)) < max(value) as released, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 6) as duration_sec,
         round(avg(value) filter (event_type <> 'error'), 9) as known_mean
       from events group by 1""",
)
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Extremes, mean, first and final reading, change, and whether it came back down.

    Errors play the part of readings whose value is unknown and are left out of one mean."""
    when = F.struct("t", "event_id")
    first, final = F.min_by("value", when), F.max_by("value", when)
    return readings(spark, d).groupBy("entity").agg(
        F.count("*").alias("num_samples"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 9).alias("mean"),
        first.alias("first"), final.alias("final"), F.round(final - first, 2).alias("delta"), (final < F.max("value")).alias("released"),
        F.round((F.max("t") - F.min("t")) / 1_000_000, 6).alias("duration_sec"),
        F.round(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), 9).alias("known_mean"))


@query(
    "counter_rates",
    """with c as (select user_id, epoch_us(ts) as t, event_id, sum(value * 1048576) over w as bytes, count(*) over w as ops from events
                  window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
            g as (select user_id as entity, arg_max(bytes, (t, event_id)) - arg_min(bytes, (t, event_id)) as b,
                         arg_max(ops, (t, event_id)) - arg_min(ops, (t, event_id)) as ops, greatest((max(t) - min(t)) / 1e6, 0.001) as sec from c group by 1)
       select entity, round(b, 0) as total_bytes, ops as total_ops, round(b / 1048576 / sec, 9) as mb_per_sec, round(ops / sec, 9) as ops_per_sec from g""",
)
def counter_rates(spark: SparkSession, d: str) -> DataFrame:
    """Growing counters of bytes and operations: change over the run and rate per second."""
    r = readings(spark, d).withColumns({"b": F.col("value") * 1_048_576, "one": F.lit(1)})
    counters = prefix(r, ["entity"], ["t", "event_id"], {"bytes": ("sum", "b"), "ops": ("count", "one")})
    when = F.struct("t", "event_id")
    change = lambda c: F.max_by(c, when) - F.min_by(c, when)
    g = counters.groupBy("entity").agg(
        change("bytes").alias("b"), change("ops").alias("n"),
        F.greatest((F.max("t") - F.min("t")) / 1_000_000, F.lit(MIN_DURATION)).alias("sec"))
    return g.select("entity", F.round("b", 0).alias("total_bytes"), F.col("n").alias("total_ops"),
                    F.round(F.col("b") / 1_048_576 / F.col("sec"), 9).alias("mb_per_sec"), F.round(F.col("n") / F.col("sec"), 9).alias("ops_per_sec"))


@query(
    "core_balance",
    """with c as (select label, generate_subscripts(embedding, 1) as core, unnest(embedding)::double as x from embeddings),
            m as (select label, core, avg(abs(x) * 100) as load from c group by all)
       select label as entity, count(*) as cores, round(avg(load), 7) as mean_load, round(stddev_pop(load) / (avg(load) + 1e-8), 8) as balance from m group by 1""",
)
def core_balance(spark: SparkSession, d: str) -> DataFrame:
    """Mean load per core from samples with one reading per core, and how even the cores are."""
    cores = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("core", "x"))
    load = cores.groupBy("label", "core").agg(F.avg(F.abs(F.col("x").cast("double")) * 100).alias("load"))
    return load.groupBy(F.col("label").alias("entity")).agg(
        F.count("*").alias("cores"), F.round(F.avg("load"), 7).alias("mean_load"),
        F.round(F.stddev_pop("load") / (F.avg("load") + 1e-8), 8).alias("balance"))


@query(
    "snapshot_delta",
    """with d as (select user_id, cast(ts as date) as day, sum(value) as rss, count(*) as objects, max(value) as peak from events group by all),
            e as (select user_id, arg_min(rss, day) as rss_b, arg_max(rss, day) as rss_a, arg_min(objects, day) as o_b, arg_max(objects, day) as o_a,
                         arg_min(peak, day) as p_b, arg_max(peak, day) as p_a, max(day) - min(day) as days from d group by 1)
       select user_id as entity, days::bigint as days, round(rss_a - rss_b, 2) as rss_delta, o_a - o_b as objects_delta, round(p_a - p_b, 2) as peak_delta from e""",
)
def snapshot_delta(spark: SparkSession, d: str) -> DataFrame:
    """First and last daily snapshot of each entity, pivoted side by side and subtracted."""
    ev = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    snaps = ev.groupBy(F.col("user_id").alias("entity"), "day").agg(
        F.sum("value").alias("rss"), F.count("*").alias("objects"), F.max("value").alias("peak"))
    ends = snaps.groupBy("entity").agg(F.min("day").alias("d_before"), F.max("day").alias("d_after"))
    phases = snaps.join(ends, "entity").select(
        "entity", "day", "rss", "objects", "peak",
        F.explode(F.array_compact(F.array(F.when(F.col("day") == F.col("d_before"), "before"), F.when(F.col("day") == F.col("d_after"), "after")))).alias("phase"))
    wide = phases.groupBy("entity").pivot("phase", ["before", "after"]).agg(
        F.max("rss").alias("rss"), F.max("objects").alias("objects"), F.max("peak").alias("peak"), F.max("day").alias("day"))
    return wide.select(
        "entity", F.date_diff("after_day", "before_day").cast("bigint").alias("days"), F.round(F.col("after_rss") - F.col("before_rss"), 2).alias("rss_delta"),
        (F.col("after_objects") - F.col("before_objects")).alias("objects_delta"), F.round(F.col("after_peak") - F.col("before_peak"), 2).alias("peak_delta"))


@query(
    "checkpoint_transitions",
    """with c as (select user_id, cast(ts as date) as day, sum(value) as rss, count(*) as objects from events group by all),
            t as (select *, lag(day) over w as prev_day, lag(rss) over w as prev_rss, lag(objects) over w as prev_objects from c window w as (partition by user_id order by day)),
            s as (select user_id, arg_max(rss, day) - arg_min(rss, day) as total, arg_max(rss, day) < max(rss) as released from c group by 1)
       select t.user_id as entity, prev_day as from_name, day as to_name, round(rss - prev_rss, 2) as rss_delta, objects - prev_objects as objects_delta,
              (day - prev_day)::bigint as days, round(total, 2) as total_rss_delta, released as released_at_end
       from t join s on t.user_id = s.user_id where prev_day is not null""",
)
def checkpoint_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Change from each named checkpoint to the next, with the totals of the run."""
    ev = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    points = ev.groupBy(F.col("user_id").alias("entity"), "day").agg(F.sum("value").alias("rss"), F.count("*").alias("objects"))
    numbered = positions(points, ["entity"], ["day"])
    w = Window.partitionBy("entity", "__block").orderBy("row_pos")
    steps = drop_halo(
        with_halo(numbered, F.col("row_pos"), before=1, after=0, block=1_000_000)
        .withColumns({"p_day": F.lag("day").over(w), "p_rss": F.lag("rss").over(w), "p_objects": F.lag("objects").over(w)}))
    last = F.max_by("rss", "day")
    totals = points.groupBy("entity").agg(
        F.round(last - F.min_by("rss", "day"), 2).alias("total_rss_delta"), (last < F.max("rss")).alias("released_at_end"))
    return steps.filter("p_day is not null").join(totals, "entity").select(
        "entity", F.col("p_day").alias("from_name"), F.col("day").alias("to_name"), F.round(F.col("rss") - F.col("p_rss"), 2).alias("rss_delta"),
        (F.col("objects") - F.col("p_objects")).alias("objects_delta"), F.date_diff("day", "p_day").cast("bigint").alias("days"),
        "total_rss_delta", "released_at_end")


@query(
    "throughput",
    """select event_type, count(*) as num_samples, round(sum(value), 2) as total_time, round(count(*) / sum(value), 9) as throughput,
              round(sum(value) / count(*), 8) as mean_latency from events group by 1""",
)
def throughput(spark: SparkSession, d: str) -> DataFrame:
    t = readings(spark, d).groupBy("event_type").agg(F.count("*").alias("num_samples"), F.sum("value").alias("s"))
    return t.select("event_type", "num_samples", F.round("s", 2).alias("total_time"), F.round(F.col("num_samples") / F.col("s"), 9).alias("throughput"),
                    F.round(F.col("s") / F.col("num_samples"), 8).alias("mean_latency"))


@query(
    "latency_percentiles",
    """select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95,
              round(quantile_cont(value, 0.99), 6) as p99 from events group by 1""",
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of measured values, not derived ones."""
    p = percentiles(readings(spark, d), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query(
    "latency_approx",
    "select event_type, true as p50_in_bound, true as p95_in_bound, true as p99_in_bound from (select distinct event_type from events where value is not null)",
)
def latency_approx(spark: SparkSession, d: str) -> DataFrame:
    """Whether each approximate percentile lies within half a percent of its rank."""
    rows = readings(spark, d).join(F.broadcast(approx_percentiles(spark, d)), "event_type")
    share = lambda c: F.avg(c.cast("double"))
    at = lambda c, p: (share(F.col("value") < F.col(c)) <= p + 0.005) & (share(F.col("value") <= F.col(c)) >= p - 0.005)
    return rows.groupBy("event_type").agg(*[at(c, p).alias(f"{c}_in_bound") for c, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def approx_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The approximate form: one mergeable summary per group, no value counts."""
    q = F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 10_000)
    return readings(spark, d).groupBy("event_type").agg(q.alias("q")).select(
        "event_type", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))
