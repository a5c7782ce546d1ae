"""Sorting, limits, top-k and physical layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.skew import positions, top_per_group
from larkspan.registry import query
from larkspan.sources.tables import table


@query(
    "sort_nulls",
    """select c_custkey, case when c_acctbal < 0 then null else c_acctbal end as balance from customer
       order by balance asc nulls last, c_custkey desc""",
)
def sort_nulls(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return c.orderBy(F.asc_nulls_last("balance"), F.desc("c_custkey"))


@query(
    "sort_directions",
    "with t as (select c_custkey, case when c_acctbal < 0 then null else c_acctbal end as b from customer) "
    """select rule, arg_min(c_custkey, i) as first_key, arg_max(c_custkey, i) as last_key from (
         select c_custkey, 'asc_nulls_first' as rule, row_number() over (order by b asc nulls first, c_custkey) as i from t union all
         select c_custkey, 'asc_nulls_last', row_number() over (order by b asc nulls last, c_custkey) from t union all
         select c_custkey, 'desc_nulls_first', row_number() over (order by b desc nulls first, c_custkey) from t union all
         select c_custkey, 'desc_nulls_last', row_number() over (order by b desc nulls last, c_custkey) from t) group by 1""",
)
def sort_directions(spark: SparkSession, d: str) -> DataFrame:
    """First and last row under each null placement: two bounded top-1 sorts per rule."""
    t = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("b"))
    rules = {
        "asc_nulls_first": (F.asc_nulls_first("b"), F.desc_nulls_last("b")),
        "asc_nulls_last": (F.asc_nulls_last("b"), F.desc_nulls_first("b")),
        "desc_nulls_first": (F.desc_nulls_first("b"), F.asc_nulls_last("b")),
        "desc_nulls_last": (F.desc_nulls_last("b"), F.asc_nulls_first("b")),
    }
    out = None
    for rule, (forward, backward) in rules.items():
        ends = (
            t.orderBy(forward, F.asc("c_custkey")).limit(1).select(F.lit("first_key").alias("e"), "c_custkey")
            .unionByName(t.orderBy(backward, F.desc("c_custkey")).limit(1).select(F.lit("last_key").alias("e"), "c_custkey"))
            .groupBy(F.lit(rule).alias("rule")).pivot("e", ["first_key", "last_key"]).agg(F.max("c_custkey")))
        out = ends if out is None else out.unionByName(ends)
    return out


@query("sort_partitions", "select l_suppkey, l_shipdate, l_extendedprice from lineitem")
def sort_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Rows hashed by supplier and day and sorted inside each partition: no global order, no range shuffle, and a supplier with
    many lines is spread."""
    return (
        table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
        .repartition("l_suppkey", "l_shipdate").sortWithinPartitions("l_suppkey", F.desc("l_shipdate")))


@query(
    "page_rows",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100",
)
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query(
    "topk",
    """select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
       order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 100""",
)
def topk(spark: SparkSession, d: str) -> DataFrame:
    """Top 100 lines: each task keeps its own 100, one merge at the end."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)


@query(
    "topk_group",
    """select o_orderpriority, o_orderkey, o_totalprice, row_number() over w as place from orders
       window w as (partition by o_orderpriority order by o_totalprice desc, o_orderkey) qualify place <= 5""",
)
def topk_group(spark: SparkSession, d: str) -> DataFrame:
    """Top 5 per priority: few keys hold everything, so groups are cut before ranking."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_per_group(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderkey"], 5)


@query(
    "range_layout",
    """select layout, count(*) as n, min(l_shipdate) as low, max(l_shipdate) as high, layout = 'range' as disjoint
       from lineitem, (values ('range'), ('coalesced')) t(layout) group by layout""",
)
def range_layout(spark: SparkSession, d: str) -> DataFrame:
    """A range layout by ship date and a hashed one merged to fewer partitions: rows, ends, and whether partitions share no day."""
    parts = layout_parts(spark, d)
    w = Window.partitionBy("layout").orderBy("low", "high")  # one row per partition of the layout
    return parts.withColumn("before", F.lag("high").over(w)).groupBy("layout").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.bool_and(F.coalesce(F.col("before") < F.col("low"), F.lit(True))).alias("disjoint"))


def layout_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per output partition after a range layout by ship date, then merged to fewer partitions."""
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    li = table(spark, d, "lineitem").select("l_shipdate", "l_orderkey")
    ranged = li.repartitionByRange(n, "l_shipdate").withColumn("part", F.spark_partition_id())
    by_range = ranged.groupBy("part").agg(
        F.count("*").alias("n"), F.min("l_shipdate").alias("low"), F.max("l_shipdate").alias("high"))
    merged = li.repartition(n, "l_orderkey").coalesce(max(2, n // 4)).withColumn("part", F.spark_partition_id()).groupBy("part").agg(
        F.count("*").alias("n"), F.min("l_shipdate").alias("low"), F.max("l_shipdate").alias("high"))
    return by_range.withColumn("layout", F.lit("range")).unionByName(merged.withColumn("layout", F.lit("coalesced")))


@query(
    "sort_keys",
    "select l_orderkey, l_partkey, l_extendedprice from lineitem order by l_orderkey, l_partkey, l_extendedprice",
)
def sort_keys(spark: SparkSession, d: str) -> DataFrame:
    """Global key sort: ranges of the key, sorted inside. Ties of a hot key are spread by the
    further sort columns, which take part in the ranges."""
    cols = ["l_orderkey", "l_partkey", "l_extendedprice"]
    return table(spark, d, "lineitem").select(*cols).repartitionByRange(*cols).sortWithinPartitions(*cols)


@query(
    "row_index",
    "select vec_id, label, row_number() over (order by vec_id) - 1 as idx from embeddings",
)
def row_index(spark: SparkSession, d: str) -> DataFrame:
    """A gap-free global index without moving everything into one partition."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    return positions(v, [], ["vec_id"], "idx").select("vec_id", "label", (F.col("idx") - 1).alias("idx"))
