"""Grouping: hash aggregates, grouping sets, pivots, distinct and approximate aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.skew import drop_halo, percentiles, prefix, ranks, salts, with_halo
from larkspan.registry import query
from larkspan.session import spread
from larkspan.sources.tables import table


@query(
    "agg_q1",
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty,
              round(sum(l_extendedprice), 2) as sum_base_price,
              round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price,
              round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) as sum_charge,
              round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 4) as avg_price,
              round(avg(l_discount), 6) as avg_disc, min(l_tax) as min_tax, max(l_tax) as max_tax, count(*) as count_order
       from lineitem where l_shipdate <= timestamp '2001-06-01' group by all""",
)
def agg_q1(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.expr("timestamp_ntz'2001-06-01'"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(net), 4).alias("sum_disc_price"),
        F.round(F.sum(net * (1 + F.col("l_tax"))), 4).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.mean("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.min("l_tax").alias("min_tax"), F.max("l_tax").alias("max_tax"), F.count("*").alias("count_order"),
    )


_SETS = """select o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus) as int) as g_status,
       cast(grouping_id(o_orderstatus, o_orderpriority) as bigint) as gid,
       count(*) as n, round(sum(o_totalprice), 2) as total from orders group by """


def _set_aggs() -> list[Column]:
    return [
        F.grouping("o_orderstatus").cast("int").alias("g_status"),
        F.grouping_id("o_orderstatus", "o_orderpriority").cast("bigint").alias("gid"),
        F.count("*").alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    ]


@query("agg_rollup", _SETS + "rollup (o_orderstatus, o_orderpriority)")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(*_set_aggs())


@query("agg_cube", _SETS + "cube (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(*_set_aggs())


@query("agg_grouping_sets", _SETS + "grouping sets ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
def agg_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([[status, prio], [prio], []], status, prio).agg(*_set_aggs())


@query(
    "pivot_status",
    """select o_orderpriority, round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as F_total,
              count(*) filter (o_orderstatus = 'F') as F_n,
              round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) as O_total,
              count(*) filter (o_orderstatus = 'O') as O_n,
              round(sum(o_totalprice) filter (o_orderstatus = 'P'), 2) as P_total,
              count(*) filter (o_orderstatus = 'P') as P_n
       from orders group by 1""",
)
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    """Explicit pivot values: no extra pass to find them."""
    return (
        table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"])
        .agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "unpivot_metrics",
    """with t as (select s_nationkey, min(s_acctbal) as low, max(s_acctbal) as high, round(avg(s_acctbal), 4) as mean
                  from supplier group by 1)
       select s_nationkey, metric, amount from t unpivot (amount for metric in (low, high, mean))""",
)
def unpivot_metrics(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"), F.round(F.avg("s_acctbal"), 4).alias("mean"))
    return wide.unpivot("s_nationkey", ["low", "high", "mean"], "metric", "amount")


@query(
    "agg_distinct",
    """select l_returnflag, count(distinct l_partkey) as parts, count(distinct (l_suppkey, l_linenumber)) as supp_lines,
              round(sum(distinct l_quantity), 2) as qty_distinct,
              array_to_string(list_sort(list(distinct l_linestatus)), ',') as statuses
       from lineitem group by 1""",
)
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Several distinct aggregates. Side by side in one aggregate each would multiply the rows,
    so the two over large domains are counted in two stages by themselves and joined."""
    li = spread(table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus"))
    pair = F.struct("l_suppkey", "l_linenumber")
    parts = salted_distinct(li, "l_returnflag", "l_partkey", "parts")
    lines = salted_distinct(li.select("l_returnflag", pair.alias("pair")), "l_returnflag", "pair", "supp_lines")
    small = li.groupBy("l_returnflag", "l_quantity", "l_linestatus").agg(F.count("*").alias("n")).groupBy("l_returnflag").agg(
        F.round(F.sum_distinct("l_quantity"), 2).alias("qty_distinct"),
        F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("statuses"))
    return parts.join(lines, "l_returnflag").join(small, "l_returnflag")


@query(
    "agg_approx",
    """select l_returnflag, count(*) as n, count(distinct l_orderkey) as orders_exact, count(distinct l_orderkey) as orders_bitmap,
      true as approx_in_bound, true as hll_in_bound, true as median_in_bound from lineitem group by 1""",
)
def agg_approx(spark: SparkSession, d: str) -> DataFrame:
    """Sketches held to their error bounds: four standard errors for counts, one row in a hundred for the median."""
    s = sketches(spark, d)
    rank = table(spark, d, "lineitem").join(F.broadcast(s.select("l_returnflag", "median_approx")), "l_returnflag").groupBy("l_returnflag").agg(
        F.avg((F.col("l_extendedprice") < F.col("median_approx")).cast("double")).alias("below"),
        F.avg((F.col("l_extendedprice") <= F.col("median_approx")).cast("double")).alias("upto"))
    near = lambda c, e: F.abs(F.col(c) / F.col("orders_exact") - 1) <= e
    return s.join(rank, "l_returnflag").select(
        "l_returnflag", "n", "orders_exact", "orders_bitmap", near("orders_approx", 0.08).alias("approx_in_bound"),
        near("orders_hll", 0.04).alias("hll_in_bound"), ((F.col("below") <= 0.51) & (F.col("upto") >= 0.49)).alias("median_in_bound"))


def sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches next to the exact figures they stand for."""
    li = table(spark, d, "lineitem")
    sketches = li.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.02).alias("orders_approx"),
        F.hll_sketch_agg("l_orderkey", 14).alias("hll"),
        F.percentile_approx("l_extendedprice", 0.5, 10000).alias("median_approx"),
        F.count_min_sketch("l_suppkey", F.lit(0.001), F.lit(0.99), F.lit(42)).alias("cms"),
        F.histogram_numeric("l_quantity", F.lit(5)).alias("hist"),
        F.count("*").alias("n"),
    )
    # A distinct aggregate beside a sketch would build one sketch per distinct value.
    exact = salted_distinct(li, "l_returnflag", "l_orderkey", "orders_exact")
    bits = (
        li.groupBy("l_returnflag", F.bitmap_bucket_number("l_orderkey").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("l_orderkey")).alias("bitmap"))
        .groupBy("l_returnflag")
        .agg(F.sum(F.bitmap_count("bitmap")).alias("orders_bitmap"))
    )
    return sketches.join(bits, "l_returnflag").join(exact, "l_returnflag").select(
        "l_returnflag", "n", "orders_exact", "orders_approx", "orders_bitmap",
        F.hll_sketch_estimate("hll").alias("orders_hll"), "median_approx",
        F.length("cms").alias("cms_bytes"), F.size("hist").alias("hist_bins"),
    )


@query(
    "agg_approx_union",
    """select year(o_orderdate)::int as y, count(distinct month(o_orderdate)) as months, count(distinct o_custkey) as customers_exact, true as approx_in_bound
       from orders group by 1""",
)
def agg_approx_union(spark: SparkSession, d: str) -> DataFrame:
    """Sketches kept per month and merged per year: distinct users without another scan."""
    return union_of_sketches(table(spark, d, "orders"), "o_orderdate", "o_custkey").select(
        "y", "months", F.col("bits").alias("customers_exact"), (F.abs(F.col("approx") / F.col("bits") - 1) <= 0.08).alias("approx_in_bound"))


def union_of_sketches(df: DataFrame, day: str, key: str) -> DataFrame:
    """Per year: months, approx and bits, the distinct keys by merged sketches and by merged bitmaps. A bitmap holds one
    bucket of keys, so bitmaps are kept and merged by bucket."""
    when = [F.year(day).alias("y"), F.month(day).alias("m")]
    monthly = df.groupBy(*when).agg(F.hll_sketch_agg(key, 12).alias("sketch"))
    bitmaps = df.groupBy(*when, F.bitmap_bucket_number(key).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))
    exact = bitmaps.groupBy("y", "b").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("bits")).groupBy("y").agg(F.sum("bits").alias("bits"))
    approx = monthly.groupBy("y").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx"), F.count("*").alias("months"))
    return approx.join(exact, "y")


@query(
    "frequent_values",
    """select (select count(*) from (select l_returnflag from lineitem group by 1 having count(*) >= 0.2 * (select count(*) from lineitem))) as flags_found,
      (select count(*) from (select l_linestatus from lineitem group by 1 having count(*) >= 0.2 * (select count(*) from lineitem))) as statuses_found,
      true as q25_in_bound, true as q50_in_bound, true as q75_in_bound""",
)
def frequent_values(spark: SparkSession, d: str) -> DataFrame:
    """How many of the truly frequent values the frequent-items job lists, and whether the approximate quantiles lie at their ranks."""
    li = table(spark, d, "lineitem")
    met = F.broadcast(frequent_items(spark, d))  # one row
    n = li.count()
    found = []
    for col, listed in (("l_returnflag", "flags"), ("l_linestatus", "statuses")):
        often = li.groupBy(col).count().filter(F.col("count") >= 0.2 * n)
        found.append(often.crossJoin(met).agg(F.count_if(F.array_contains(F.split(listed, ","), F.col(col))).alias(f"{listed}_found")))
    q = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    at = lambda c, p: (F.avg((F.col("l_quantity") < F.col(c)).cast("double")) <= p + 0.01) & (F.avg((F.col("l_quantity") <= F.col(c)).cast("double")) >= p - 0.01)
    bounds = li.crossJoin(met).agg(*[at(c, p).alias(f"{c}_in_bound") for c, p in q.items()])
    return found[0].crossJoin(found[1]).crossJoin(bounds)


def frequent_items(spark: SparkSession, d: str) -> DataFrame:
    """Approximate quantiles and frequent items through the statistic functions."""
    li = table(spark, d, "lineitem")
    q = li.approxQuantile("l_quantity", [0.25, 0.5, 0.75], 0.001)
    items = li.select("l_returnflag", "l_linestatus").freqItems(["l_returnflag", "l_linestatus"], 0.2)
    return items.select(
        F.array_join(F.sort_array("l_returnflag_freqItems"), ",").alias("flags"),
        F.array_join(F.sort_array("l_linestatus_freqItems"), ",").alias("statuses"),
        *[F.lit(v).alias(n) for n, v in zip(("q25", "q50", "q75"), q)],
    )


@query(
    "agg_stats",
    """select l_linestatus, round(stddev_samp(l_quantity), 6) as sd, round(var_samp(l_quantity), 6) as v,
              round(stddev_pop(l_quantity), 6) as sd_pop, round(var_pop(l_quantity), 6) as v_pop,
              round(corr(l_quantity, l_extendedprice), 6) as r,
              round(covar_pop(l_quantity, l_extendedprice), 3) as cp, round(covar_samp(l_quantity, l_extendedprice), 3) as cs,
              round(regr_slope(l_extendedprice, l_quantity), 5) as slope,
              round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept,
              round(regr_r2(l_extendedprice, l_quantity), 6) as r2,
              round((avg(pow(l_quantity, 3)) - 3 * avg(l_quantity) * avg(l_quantity * l_quantity)
                     + 2 * pow(avg(l_quantity), 3)) / pow(var_pop(l_quantity), 1.5), 5) as skew,
              round(kurtosis_pop(l_quantity), 5) as kurt
       from lineitem group by 1""",
)
def agg_stats(spark: SparkSession, d: str) -> DataFrame:
    q, p = "l_quantity", "l_extendedprice"
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.stddev(q), 6).alias("sd"), F.round(F.variance(q), 6).alias("v"),
        F.round(F.stddev_pop(q), 6).alias("sd_pop"), F.round(F.var_pop(q), 6).alias("v_pop"),
        F.round(F.corr(q, p), 6).alias("r"), F.round(F.covar_pop(q, p), 3).alias("cp"),
        F.round(F.covar_samp(q, p), 3).alias("cs"), F.round(F.regr_slope(p, q), 5).alias("slope"),
        F.round(F.regr_intercept(p, q), 4).alias("intercept"), F.round(F.regr_r2(p, q), 6).alias("r2"),
        F.round(F.skewness(q), 5).alias("skew"), F.round(F.kurtosis(q), 5).alias("kurt"),
    )


@query(
    "agg_extreme",
    """with c as (select l_returnflag, l_quantity, count(*) as c from lineitem group by all),
            m as (select l_returnflag, arg_max(l_quantity, (c, -l_quantity)) as mode_qty from c group by 1)
       select l.l_returnflag, max(mode_qty) as mode_qty,
              arg_max(l_partkey, (l_extendedprice, l_partkey)) as priciest_part,
              arg_min(l_partkey, (l_extendedprice, l_partkey)) as cheapest_part,
              round(quantile_cont(l_extendedprice, 0.5), 4) as median_price,
              round(quantile_cont(l_extendedprice, 0.9), 4) as p90_price,
              arg_min(l_orderkey, (l_shipdate, l_orderkey)) as first_order,
              arg_max(l_orderkey, (l_shipdate, l_orderkey)) as last_order
       from lineitem l join m on l.l_returnflag = m.l_returnflag group by 1""",
)
def agg_extreme(spark: SparkSession, d: str) -> DataFrame:
    """Mode, median, percentile and extreme rows of three very large groups."""
    li = table(spark, d, "lineitem")
    price, ship = F.struct("l_extendedprice", "l_partkey"), F.struct("l_shipdate", "l_orderkey")
    extremes = li.groupBy("l_returnflag").agg(
        F.max_by("l_partkey", price).alias("priciest_part"), F.min_by("l_partkey", price).alias("cheapest_part"),
        F.min_by("l_orderkey", ship).alias("first_order"), F.max_by("l_orderkey", ship).alias("last_order"),
    )
    modes = (
        li.groupBy("l_returnflag", "l_quantity").count().groupBy("l_returnflag")
        .agg(F.max_by("l_quantity", F.struct("count", -F.col("l_quantity"))).alias("mode_qty"))
    )
    mid = percentiles(li, ["l_returnflag"], "l_extendedprice", {"median_price": 0.5, "p90_price": 0.9})
    mid = mid.select("l_returnflag", F.round("median_price", 4).alias("median_price"),
                     F.round("p90_price", 4).alias("p90_price"))
    return extremes.join(modes, "l_returnflag").join(mid, "l_returnflag")


@query(
    "agg_boolean",
    """select c_mktsegment, count_if(c_acctbal < 0) as n_negative, bool_and(c_acctbal > -1000) as all_above,
              bool_or(c_acctbal > 9990) as any_rich, bit_and(c_custkey) as b_and, bit_or(c_custkey) as b_or,
              bit_xor(c_custkey) as b_xor
       from customer group by 1""",
)
def agg_boolean(spark: SparkSession, d: str) -> DataFrame:
    bal = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.count_if(bal < 0).alias("n_negative"), F.bool_and(bal > -1000).alias("all_above"),
        F.bool_or(bal > 9990).alias("any_rich"), F.bit_and("c_custkey").alias("b_and"),
        F.bit_or("c_custkey").alias("b_or"), F.bit_xor("c_custkey").alias("b_xor"),
    )


@query("distinct_rows", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "dedupe_latest",
    """select user_id, event_type, event_id, ts, value from events
       qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""",
)
def dedupe_latest(spark: SparkSession, d: str) -> DataFrame:
    """One row per key, the newest: a max over a struct combines before the shuffle, where a
    row number would sort the whole group."""
    newest = F.max(F.struct("ts", "event_id", "value")).alias("m")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(newest).select(
        "user_id", "event_type", "m.event_id", "m.ts", "m.value")


@query("dedupe_keys", "select count(*) as n_pairs from (select distinct l_orderkey, l_linenumber from lineitem)")
def dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n_pairs"))


@query(
    "summary_table",
    """with t as (select 'c_acctbal' as name, c_acctbal as v from customer union all
                  select 'c_nationkey', c_nationkey from customer)
       select name, count(v) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as stddev, min(v) as min, max(v) as max,
              round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as p50,
              round(quantile_cont(v, 0.75), 4) as p75
       from t group by 1""",
)
def summary_table(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column."""
    c = table(spark, d, "customer")
    long = c.select(F.col("c_acctbal"), F.col("c_nationkey").cast("double").alias("c_nationkey")).unpivot(
        [], ["c_acctbal", "c_nationkey"], "name", "v")
    basic = long.groupBy("name").agg(
        F.count("v").alias("n"), F.round(F.mean("v"), 4).alias("mean"), F.round(F.stddev("v"), 4).alias("stddev"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    quart = percentiles(long, ["name"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return basic.join(quart.select("name", *[F.round(p, 4).alias(p) for p in ("p25", "p50", "p75")]), "name")


@query(
    "crosstab",
    """select event_type, count(*) filter (dayofweek(ts) in (0, 6)) as weekend,
              count(*) filter (dayofweek(ts) not in (0, 6)) as weekday from events group by 1""",
)
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("weekday")
    return (
        table(spark, d, "events").withColumn("kind", kind).groupBy("event_type")
        .pivot("kind", ["weekend", "weekday"]).count().fillna(0, ["weekend", "weekday"])
    )


@query(
    "observe_counts",
    """select count(*) as n_rows, count_if(value > 100) as n_large, round(sum(value), 2) as total, max(value) as top
       from events""",
)
def observe_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters filled while another job runs; here while the events are scanned into nothing.

    The observed job has a session of its own: a session that has observed anything can no
    longer ship some fitted models to its tasks."""
    obs = Observation("events")
    ev = table(spark.newSession(), d, "events").select("value").observe(
        obs, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value") > 100).alias("n_large"),
        F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("top"))
    ev.write.format("noop").mode("overwrite").save()
    m = obs.get
    return spark.createDataFrame(
        [(m["n_rows"], m["n_large"], m["total"], m["top"])], "n_rows bigint, n_large bigint, total double, top double")


@query(
    "group_cum",
    """with p as (select *, row_number() over w as pos from events window w as (partition by user_id order by ts, event_id)),
            x as (select user_id, arg_max(event_id, (value, -event_id)) as idxmax, arg_min(event_id, (value, event_id)) as idxmin,
                         count(distinct event_type) as nunique, max(case when pos = 3 then event_id end) as third
                  from p group by 1)
       select p.event_id, p.user_id, pos - 1 as cumcount, round(sum(value) over w, 2) as cumsum,
              max(value) over w as cummax, min(value) over w as cummin,
              round(exp(sum(ln(1 + value / 1000)) over w), 6) as cumprod,
              round(value - lag(value) over w, 2) as diff, lag(event_id, 2, -1) over w as shifted,
              last_value(case when event_type = 'purchase' then value end ignore nulls) over w as ffilled,
              rank() over (partition by p.user_id order by value) as value_rank, idxmax, idxmin, nunique, third
       from p join x on p.user_id = x.user_id
       window w as (partition by p.user_id order by ts, p.event_id)""",
)
def group_cum(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative, shifting and ranking operations inside each user's history."""
    ev = table(spark, d, "events").select(
        "event_id", "user_id", "ts", "event_type", "value", (1 + F.col("value") / 1000).alias("growth"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"), F.lit(1).alias("one"))
    run = prefix(ev, ["user_id"], ["ts", "event_id"], {
        "pos": ("count", "one"), "cumsum": ("sum", "value"), "cummax": ("max", "value"), "cummin": ("min", "value"),
        "cumprod": ("product", "growth"), "ffilled": ("last", "paid")})
    halo = with_halo(run, F.col("pos"), before=2, after=0, block=1_000_000)
    w = Window.partitionBy("user_id", "__block").orderBy("pos")
    shifted = drop_halo(halo.withColumn("diff", F.round(F.col("value") - F.lag("value").over(w), 2))
                        .withColumn("shifted", F.lag("event_id", 2, -1).over(w)))
    per_user = run.groupBy("user_id").agg(
        F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("idxmax"),
        F.min_by("event_id", F.struct("value", "event_id")).alias("idxmin"),
        F.count_distinct("event_type").alias("nunique"),
        F.max(F.when(F.col("pos") == 3, F.col("event_id"))).alias("third"))
    by_value = ranks(ev.select("event_id", "user_id", "value"), ["user_id"], "value", ["event_id"]).select(
        "event_id", F.col("rank").alias("value_rank"))
    return (
        shifted.join(per_user, "user_id").join(by_value, "event_id")
        .select("event_id", "user_id", (F.col("pos") - 1).alias("cumcount"), F.round("cumsum", 2).alias("cumsum"),
                "cummax", "cummin", F.round("cumprod", 6).alias("cumprod"), "diff", "shifted", "ffilled", "value_rank",
                "idxmax", "idxmin", "nunique", "third")
    )


@query(
    "log_stats",
    """select regexp_extract(url, '^https?://([^/]+)/', 1) as host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) as lang,
              count(*) as n, cast(sum(strlen(html)) as bigint) as bytes from pages group by all""",
)
def log_stats(spark: SparkSession, d: str) -> DataFrame:
    """Hits and bytes per host and section, parsed from the address."""
    return (
        table(spark, d, "pages")
        .groupBy(
            F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"),
            F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"))
        .agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).cast("bigint").alias("bytes"))
    )


def salted_distinct(df: DataFrame, key: str, item: str, out: str) -> DataFrame:
    """Exact distinct count per key in two stages: the item decides the salt, so equal items
    meet in the same task and the per-salt counts simply add up."""
    return (
        df.groupBy(key, F.pmod(F.xxhash64(item), F.lit(salts(df))).alias("salt"))
        .agg(F.count_distinct(item).alias("c"))
        .groupBy(key).agg(F.sum("c").alias(out))
    )


@query(
    "agg_salted",
    """select event_type, count(distinct user_id) as users, count(*) as n, round(sum(value), 2) as total
       from events group by 1""",
)
def agg_salted(spark: SparkSession, d: str) -> DataFrame:
    """Skewed grouping: a handful of keys hold everything, so the first stage is salted."""
    ev = table(spark, d, "events")
    users = salted_distinct(ev, "event_type", "user_id", "users")
    totals = (
        ev.groupBy("event_type", F.pmod(F.xxhash64("event_id"), F.lit(salts(ev))).alias("salt"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("s"))
        .groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))
    )
    return users.join(totals, "event_type")
