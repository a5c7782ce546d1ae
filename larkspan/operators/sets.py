"""Set operations and concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.registry import query
from larkspan.sources.tables import table, tables


def _nations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, s = tables(spark, d, "customer", "supplier")
    return (
        c.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey")),
        s.filter("s_acctbal > 2000").select(F.col("s_nationkey").alias("nationkey")),
    )


_A = "select c_nationkey as nationkey from customer where c_acctbal > 9000"
_B = "select s_nationkey as nationkey from supplier where s_acctbal > 2000"


@query("set_union", f"{_A} union all {_B}")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _nations(spark, d)
    return a.union(b)


@query("set_union_distinct", f"{_A} union {_B}")
def set_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a, b = _nations(spark, d)
    return a.unionAll(b).distinct()


@query(
    "set_union_by_name",
    """select c_custkey as id, c_name as name, c_mktsegment as segment, null::double as balance from customer
       union all select s_suppkey, s_name, null, s_acctbal from supplier""",
)
def set_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    c, s = tables(spark, d, "customer", "supplier")
    a = c.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_intersect", f"{_A} intersect {_B}")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _nations(spark, d)
    return a.intersect(b)


@query("set_intersect_all", f"{_A} intersect all {_B}")
def set_intersect_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _nations(spark, d)
    return a.intersectAll(b)


_C = "select l_partkey, l_returnflag from lineitem where l_quantity >= 49"
_D = "select l_partkey, l_returnflag from lineitem where l_discount >= 0.08"


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem")
    return (
        li.filter("l_quantity >= 49").select("l_partkey", "l_returnflag"),
        li.filter("l_discount >= 0.08").select("l_partkey", "l_returnflag"),
    )


@query("set_except", f"{_C} except {_D}")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lines(spark, d)
    return a.subtract(b)


@query("set_except_all", f"{_C} except all {_D}")
def set_except_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _lines(spark, d)
    return a.exceptAll(b)


@query(
    "concat_update",
    """with upd as (select c_custkey, max(o_totalprice) as top from orders join customer on o_custkey = c_custkey
                    where o_totalprice > 400000 group by 1),
            frames as (select c_custkey as id, c_acctbal as amount, 'customer' as kind from customer
                       union all select s_suppkey, s_acctbal, 'supplier' from supplier)
       select id, kind, case when kind = 'customer' then coalesce(top, amount) else amount end as amount
       from frames left join upd on id = c_custkey and kind = 'customer'""",
)
def concat_update(spark: SparkSession, d: str) -> DataFrame:
    """Two frames stacked, then amounts overwritten where the update table has a value."""
    c, s, o = tables(spark, d, "customer", "supplier", "orders")
    frames = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.lit("customer").alias("kind"))
    frames = frames.unionByName(
        s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("amount"), F.lit("supplier").alias("kind")))
    update = (
        o.filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("top"))
        .withColumn("kind", F.lit("customer")))
    return frames.join(update, ["id", "kind"], "left").select("id", "kind", F.coalesce("top", "amount").alias("amount"))
