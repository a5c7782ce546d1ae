"""Joins: equi, outer, semi, range, as-of, interval, null-safe, star, cogroup."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.skew import micros, prefix, salts
from larkspan.registry import query
from larkspan.sources.tables import table, tables

BROADCAST_ROWS = 1_000_000


@query(
    "join_star",
    """select r_name, n_name, cast(year(o_orderdate) as int) as order_year,
              round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, count(*) as n_lines
       from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
       group by all""",
)
def join_star(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by region, nation and order year.

    The dimension side is joined first, so the fact table is shuffled once; whether a side
    is broadcast is left to adaptive execution, which looks at its real size.
    """
    li, o, c, n, r = tables(spark, d, "lineitem", "orders", "customer", "nation", "region")
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    buyers = c.join(place, c.c_nationkey == place.n_nationkey).select("c_custkey", "n_name", "r_name")
    placed = o.join(buyers, o.o_custkey == buyers.c_custkey).select(
        "o_orderkey", F.year("o_orderdate").alias("order_year"), "n_name", "r_name"
    )
    return (
        li.join(placed, li.l_orderkey == placed.o_orderkey)
        .groupBy("r_name", "n_name", "order_year")
        .agg(
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"),
            F.count("*").alias("n_lines"),
        )
    )


@query(
    "join_inner",
    """select o_orderkey, c_name, c_mktsegment, o_totalprice
       from orders join customer on o_custkey = c_custkey""",
)
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    o, c = tables(spark, d, "orders", "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query(
    "join_left",
    """select c_custkey, o_orderkey, o_totalprice from customer
       left join (select * from orders where o_totalprice > 450000) on c_custkey = o_custkey""",
)
def join_left(spark: SparkSession, d: str) -> DataFrame:
    c, o = tables(spark, d, "customer", "orders")
    big = o.filter("o_totalprice > 450000")
    return c.join(big, c.c_custkey == big.o_custkey, "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query(
    "join_right",
    """select d.doc_id, quality, toxic, lang from (select * from labels where quality = 1) l
       right join documents d on l.doc_id = d.doc_id""",
)
def join_right(spark: SparkSession, d: str) -> DataFrame:
    labels, docs = tables(spark, d, "labels", "documents")
    good = labels.filter("quality = 1")
    return good.join(docs.select("doc_id", "lang"), "doc_id", "right").select("doc_id", "quality", "toxic", "lang")


@query(
    "join_full",
    """with s as (select s_nationkey as k, count(*) as n_rich_suppliers from supplier where s_acctbal > 6000 group by 1),
            c as (select c_nationkey as k, count(*) as n_poor_customers from customer where c_acctbal < -900 group by 1)
       select coalesce(s.k, c.k) as nationkey, n_rich_suppliers, n_poor_customers from s full join c on s.k = c.k""",
)
def join_full(spark: SparkSession, d: str) -> DataFrame:
    s, c = tables(spark, d, "supplier", "customer")
    rich = s.filter("s_acctbal > 6000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(
        F.count("*").alias("n_rich_suppliers"))
    poor = c.filter("c_acctbal < -900").groupBy(F.col("c_nationkey").alias("nationkey")).agg(
        F.count("*").alias("n_poor_customers"))
    return rich.join(poor, "nationkey", "full")


@query(
    "join_semi",
    """select c_custkey, c_name from customer where exists
       (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')""",
)
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    c, o = tables(spark, d, "customer", "orders")
    urgent = o.filter("o_orderpriority = '1-URGENT'")
    return c.join(urgent, c.c_custkey == urgent.o_custkey, "left_semi").select("c_custkey", "c_name")


@query(
    "join_anti",
    """select c_custkey, c_name from customer where not exists
       (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')""",
)
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = tables(spark, d, "customer", "orders")
    urgent = o.filter("o_orderpriority = '1-URGENT'")
    return c.join(urgent, c.c_custkey == urgent.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("join_cross", "select r_name, n_name, r_regionkey = n_regionkey as home from region cross join nation")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    """The product operator itself, on the two fixed dimension tables (5 and 25 rows)."""
    r, n = tables(spark, d, "region", "nation")
    return r.crossJoin(n).select("r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("home"))


def range_join(points: DataFrame, ranges: DataFrame, at: Column, low: Column, high: Column, width: float, cuts: int = 1) -> DataFrame:
    """Inner join on ``low <= at < high`` as an equi-join on bins of ``width``.

    Every range is repeated once per bin it touches, every point sits in one bin, so no
    pair is met twice and nothing is compared across bins. Points of one bin are cut ``cuts`` ways
    by the hash of their place, for which the (few) ranges are repeated.
    """
    binned_ranges = ranges.withColumn(
        "__bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    ).withColumn("__cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    binned_points = points.withColumn("__bin", F.floor(at / width)).withColumn("__cut", F.pmod(F.xxhash64(*points.columns), F.lit(cuts)).cast("int"))
    return binned_points.join(binned_ranges, ["__bin", "__cut"]).filter((at >= low) & (at < high)).drop("__bin", "__cut")


@query(
    "join_range",
    """with bands as (select distinct floor(o_totalprice / 20000) * 20000 as low,
                             floor(o_totalprice / 20000) * 20000 + 20000 as high from orders)
       select low, high, count(*) as n_lines, round(sum(l_extendedprice), 2) as total
       from lineitem join bands on l_extendedprice >= low and l_extendedprice < high group by low, high""",
)
def join_range(spark: SparkSession, d: str) -> DataFrame:
    """Price bands met by orders, joined to the line prices that fall into them."""
    o, li = tables(spark, d, "orders", "lineitem")
    low = (F.floor(F.col("o_totalprice") / 20000) * 20000).cast("double")
    bands = o.select(low.alias("low"), (low + 20000).alias("high")).distinct()
    hits = range_join(
        li.select("l_extendedprice", "l_orderkey", "l_linenumber"), bands, F.col("l_extendedprice"), F.col("low"), F.col("high"), 20000.0, salts(li)
    )
    return hits.groupBy("low", "high").agg(
        F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    right_cols: list[str],
    direction: str = "backward",
    tolerance_micros: int | None = None,
    allow_exact: bool = True,
    pieces: int | None = None,
) -> DataFrame:
    """Each left row with the closest right row of the same ``by`` key.

    Both sides go into one table sorted by time; the last right row seen is carried forward
    (backward match) or, on the mirrored clock, from the other end (forward match).
    """
    left_cols = left.columns
    sides = left.select(
        *left_cols, micros(on).alias("__t"), F.lit(None).cast(_struct_type(right, on, right_cols)).alias("__hit"),
        F.lit(True).alias("__left"),
    ).unionByName(
        right.select(
            *by, micros(on).alias("__t"),
            F.struct(micros(on).alias("__rt"), *right_cols).alias("__hit"), F.lit(False).alias("__left"),
        ),
        allowMissingColumns=True,
    )
    merged = sides
    if direction in ("backward", "nearest"):
        merged = merged.withColumn("__side", F.col("__left").cast("int") * (1 if allow_exact else -1))
        merged = prefix(merged, by, ["__t", "__side"], {"__back": ("last", "__hit")}, pieces)
    if direction in ("forward", "nearest"):
        merged = merged.withColumn("__mt", -F.col("__t"))
        merged = merged.withColumn("__side", F.col("__left").cast("int") * (1 if allow_exact else -1))
        merged = prefix(merged, by, ["__mt", "__side"], {"__fore": ("last", "__hit")}, pieces)
    gap = lambda c: F.abs(F.col("__t") - F.col(f"{c}.__rt"))
    if direction == "backward":
        hit = F.col("__back")
    elif direction == "forward":
        hit = F.col("__fore")
    else:
        hit = F.when(F.col("__fore").isNull() | (gap("__back") <= gap("__fore")), F.col("__back")).otherwise(
            F.col("__fore"))
    # a null key matches nothing
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in by], F.lit(True))
    out = merged.filter("__left").withColumn("__match", F.when(known, hit))
    if tolerance_micros is not None:
        out = out.withColumn("__match", F.when(gap("__match") <= tolerance_micros, F.col("__match")))
    return out.select(*left_cols, *[F.col(f"__match.{c}").alias(c) for c in right_cols])


def _struct_type(df: DataFrame, on: str, cols: list[str]):
    return df.select(F.struct(micros(on).alias("__rt"), *cols).alias("s")).schema["s"].dataType


def _purchases_and_views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, d, "events")
    buys = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = ev.filter("event_type = 'view'").select(
        "user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return buys, views


_ASOF_SQL = """
    with l as (select event_id, user_id, ts from events where event_type = 'purchase'),
         r as (select user_id, ts, event_id as view_id, value as view_value from events where event_type = 'view')
    """


@query(
    "join_asof",
    _ASOF_SQL + """select l.event_id, l.user_id, l.ts, r.view_id, r.view_value
    from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts""",
)
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    buys, views = _purchases_and_views(spark, d)
    return asof_join(buys, views, ["user_id"], "ts", ["view_id", "view_value"])


@query(
    "join_asof_forward",
    _ASOF_SQL + """select l.event_id, l.user_id, l.ts, r.view_id, r.view_value
    from l asof left join r on l.user_id = r.user_id and l.ts <= r.ts""",
)
def join_asof_forward(spark: SparkSession, d: str) -> DataFrame:
    buys, views = _purchases_and_views(spark, d)
    return asof_join(buys, views, ["user_id"], "ts", ["view_id", "view_value"], "forward")


@query(
    "join_asof_nearest",
    _ASOF_SQL + """, b as (select l.*, r.ts as bts, r.view_id as bid, r.view_value as bv
              from l asof left join r on l.user_id = r.user_id and l.ts >= r.ts),
         f as (select l.event_id, r.ts as fts, r.view_id as fid, r.view_value as fv
              from l asof left join r on l.user_id = r.user_id and l.ts <= r.ts),
         n as (select b.event_id, b.user_id, b.ts,
                      (fts is null or (bts is not null and b.ts - bts <= fts - b.ts)) as back, b.*, f.*
               from b join f on b.event_id = f.event_id)
    select event_id, user_id, ts,
           case when back and ts - bts <= interval 12 hour then bid
                when not back and fts - ts <= interval 12 hour then fid end as view_id,
           case when back and ts - bts <= interval 12 hour then bv
                when not back and fts - ts <= interval 12 hour then fv end as view_value
    from n""",
)
def join_asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Nearest view in either direction, at most twelve hours away."""
    buys, views = _purchases_and_views(spark, d)
    return asof_join(
        buys, views, ["user_id"], "ts", ["view_id", "view_value"], "nearest", tolerance_micros=12 * 3_600_000_000
    )


@query(
    "join_interval",
    """select b.event_id as purchase_id, count(*) as n_clicks, round(sum(c.value), 2) as click_value
       from events b join events c on b.user_id = c.user_id and c.event_type = 'click'
        and c.ts between b.ts - interval 6 hour and b.ts
       where b.event_type = 'purchase' group by 1""",
)
def join_interval(spark: SparkSession, d: str) -> DataFrame:
    """Clicks of the same user in the six hours before a purchase: the user's running count and sum of clicks at the purchase, less
    those just before the six hours began. No pair of a click and a purchase is formed.
    """
    span = 6 * 3_600_000_000
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t"))
    none = F.lit(None).cast("double")
    clicks = ev.filter("event_type = 'click'").select("user_id", "t", F.lit(1).alias("step"), "value", F.lit(1).alias("one"), F.lit(None).cast("bigint").alias("purchase_id"))
    edge = lambda t, step: ev.filter("event_type = 'purchase'").select(
        "user_id", t.alias("t"), F.lit(step).alias("step"), none.alias("value"), F.lit(0).alias("one"), F.col("event_id").alias("purchase_id"))
    moments = clicks.unionByName(edge(F.col("t") - span, 0)).unionByName(edge(F.col("t"), 2)).filter("user_id is not null")
    run = prefix(moments, ["user_id"], ["t", "step", "purchase_id"], {"n": ("sum", "one"), "s": ("sum", "value")})
    sign = F.when(F.col("step") == 2, 1).otherwise(-1)
    return (
        run.filter("purchase_id is not null")
        .groupBy("purchase_id")
        .agg(F.sum(sign * F.col("n")).alias("n_clicks"), F.round(F.sum(sign * F.coalesce("s", F.lit(0.0))), 2).alias("click_value"))
        .filter("n_clicks > 0")
    )


@query(
    "join_hints",
    """select strategy, n_name, count(*) as n, round(sum(s_acctbal), 2) as balance
       from supplier join nation on s_nationkey = n_nationkey,
            (values ('broadcast'), ('merge'), ('shuffle_hash')) t(strategy)
       group by all""",
)
def join_hints(spark: SparkSession, d: str) -> DataFrame:
    """The same join under three strategy hints. Broadcast is asked for only after counting
    the dimension; a larger one is merged."""
    s, n = tables(spark, d, "supplier", "nation")
    small = n.count() <= BROADCAST_ROWS
    out = None
    for name in ("broadcast", "merge", "shuffle_hash"):
        hint = name if small or name != "broadcast" else "merge"
        one = (
            s.join(n.hint(hint), s.s_nationkey == n.n_nationkey)
            .groupBy("n_name")
            .agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
            .withColumn("strategy", F.lit(name))
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "join_nullsafe",
    """with o as (select o_orderkey, case when o_orderpriority = '5-LOW' then null else o_orderpriority end as p from orders),
            t as (select case when o_orderpriority = '5-LOW' then null else o_orderpriority end as p, count(*) as weight
                  from orders group by 1)
       select o_orderkey, o.p as priority, weight from o join t on o.p is not distinct from t.p""",
)
def join_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"))
    cuts = salts(o)  # few priorities hold all orders: each is cut by the order's hash, the weights are repeated
    t = o.groupBy(F.col("priority").alias("p")).agg(F.count("*").alias("weight")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    o = o.withColumn("cut", F.pmod(F.xxhash64("o_orderkey"), F.lit(cuts)).cast("int"))
    return o.join(t, o.priority.eqNullSafe(t.p) & (o.cut == t.c)).select("o_orderkey", "priority", "weight")


@query(
    "cogroup_merge",
    """with v as (select user_id, cast(ts as date) as day, count(*) as views, sum(value) as s from events
                  where event_type = 'view' group by all),
            p as (select user_id, cast(ts as date) as day, count(*) as purchases, sum(value) as s from events
                  where event_type = 'purchase' group by all)
       select coalesce(v.user_id, p.user_id) as user_id, coalesce(v.day, p.day) as day,
              coalesce(views, 0) as views, coalesce(purchases, 0) as purchases,
              round(coalesce(p.s, 0) - coalesce(v.s, 0), 2) as surplus
       from v full join p on v.user_id = p.user_id and v.day = p.day""",
)
def cogroup_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two keyed tables merged in a cogroup.

    Each side is aggregated to one row per user and day first, and the cogroup key is a hash
    bucket of that pair sized by the row count, so no cogroup grows with a hot user.
    """
    ev = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))

    def side(kind: str, name: str) -> DataFrame:
        return ev.filter(F.col("event_type") == kind).groupBy("user_id", "day").agg(
            F.count("*").alias(name), F.sum("value").alias("s"))

    views, buys = side("view", "views"), side("purchase", "purchases")
    buckets = max(1, (views.count() + buys.count()) // 200_000)
    bucket = F.pmod(F.xxhash64("user_id", "day"), F.lit(buckets)).alias("bucket")

    def merge(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        m = a.merge(b, on=["user_id", "day"], how="outer", suffixes=("_v", "_p"))
        m["surplus"] = (m["s_p"].fillna(0.0) - m["s_v"].fillna(0.0)).round(2)
        for c in ("views", "purchases"):
            m[c] = m[c].fillna(0).astype("int64")
        return m[["user_id", "day", "views", "purchases", "surplus"]]

    return (
        views.withColumn("bucket", bucket).groupBy("bucket")
        .cogroup(buys.withColumn("bucket", bucket).groupBy("bucket"))
        .applyInPandas(merge, "user_id bigint, day date, views bigint, purchases bigint, surplus double")
    )


@query(
    "merge_combine",
    """with a as (select l_suppkey as k, count(*) as n, max(case when l_discount > 0.09 then l_tax end) as t
                  from lineitem where l_returnflag = 'R' group by 1),
            b as (select l_suppkey as k, count(*) as n, max(l_tax) as t from lineitem where l_returnflag = 'A' group by 1)
       select coalesce(a.k, b.k) as suppkey, a.n as n_x, b.n as n_y, coalesce(a.t, b.t) as tax
       from a full join b on a.k = b.k""",
)
def merge_combine(spark: SparkSession, d: str) -> DataFrame:
    """Outer merge with suffixed columns; the left value wins where both exist."""
    li = table(spark, d, "lineitem")
    a = li.filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.count("*").alias("n_x"), F.max(F.when(F.col("l_discount") > 0.09, F.col("l_tax"))).alias("tax_x"))
    b = li.filter("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("suppkey")).agg(
        F.count("*").alias("n_y"), F.max("l_tax").alias("tax_y"))
    return a.join(b, "suppkey", "full").select("suppkey", "n_x", "n_y", F.coalesce("tax_x", "tax_y").alias("tax"))
