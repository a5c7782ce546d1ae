"""Projections, filters, predicates, casts and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.registry import query
from larkspan.sources.tables import table


@query(
    "project_expr",
    """select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue,
              round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge
       from lineitem""",
)
def project_expr(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select(
        "l_orderkey", "l_linenumber", F.round(net, 4).alias("revenue"),
        F.round(net * (1 + F.col("l_tax")), 6).alias("charge"),
    )


@query(
    "columns_edit",
    """select c_custkey as customer_id, upper(c_name) as name, c_acctbal + 100 as balance,
              c_nationkey * 2 as nation_code, 'active' as status from customer""",
)
def columns_edit(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "customer")
        .withColumn("c_acctbal", F.col("c_acctbal") + 100)
        .withColumns({"nation_code": F.col("c_nationkey") * 2, "c_name": F.upper("c_name")})
        .withColumnRenamed("c_custkey", "customer_id")
        .withColumnsRenamed({"c_name": "name", "c_acctbal": "balance"})
        .withColumn("status", F.lit("active"))
        .withMetadata("balance", {"unit": "currency"})
        .drop("c_mktsegment", "c_nationkey")
    )


@query(
    "filter_range",
    """select l_orderkey, l_linenumber, l_quantity from lineitem
       where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01'
         and l_discount between 0.05 and 0.07 and l_quantity < 24""",
)
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.filter(
        (F.col("l_shipdate") >= F.expr("timestamp_ntz'1997-01-01'"))
        & (F.col("l_shipdate") < F.expr("timestamp_ntz'1998-01-01'"))
        & F.col("l_discount").between(0.05, 0.07)
        & (F.col("l_quantity") < 24)
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "predicates",
    """select p_partkey, p_type in ('PROMO', 'SMALL') as is_in, p_size between 10 and 20 as is_between,
              p_name like '%ring' as is_like, p_name ilike 'RED%' as is_ilike,
              regexp_matches(p_brand, '#1[0-9]$') as is_rlike,
              p_brand is not distinct from 'Brand#1' as is_same,
              starts_with(p_name, 'blue') as starts, ends_with(p_name, 'bolt') as ends,
              contains(p_name, 'wid') as has
       from part
       where p_type in ('PROMO', 'SMALL') or p_size between 10 and 20 or p_name like '%ring'
          or regexp_matches(p_brand, '#1[0-9]$')""",
)
def predicates(spark: SparkSession, d: str) -> DataFrame:
    in_, between = F.col("p_type").isin("PROMO", "SMALL"), F.col("p_size").between(10, 20)
    like, rlike = F.col("p_name").like("%ring"), F.col("p_brand").rlike("#1[0-9]$")
    return (
        table(spark, d, "part")
        .filter(in_ | between | like | rlike)
        .select(
            "p_partkey", in_.alias("is_in"), between.alias("is_between"), like.alias("is_like"),
            F.col("p_name").ilike("RED%").alias("is_ilike"), rlike.alias("is_rlike"),
            F.equal_null("p_brand", F.lit("Brand#1")).alias("is_same"),
            F.col("p_name").startswith("blue").alias("starts"),
            F.col("p_name").endswith("bolt").alias("ends"), F.col("p_name").contains("wid").alias("has"),
        )
    )


@query(
    "case_bucket",
    """select case when o_totalprice < 100000 then 'low' when o_totalprice < 300000 then 'mid' else 'high' end as band,
              count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1""",
)
def case_bucket(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    band = F.when(price < 100000, "low").when(price < 300000, "mid").otherwise("high")
    return (
        table(spark, d, "orders").groupBy(band.alias("band"))
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    "cast_conform",
    """select cast(o_orderkey as varchar) as order_id, cast(o_totalprice as bigint) as whole_price,
              cast(o_orderdate as date) as order_day, cast(o_totalprice as decimal(12,2)) as price,
              try_cast(o_orderpriority as int) as priority_number,
              cast(substr(o_orderpriority, 1, 1) as int) as priority
       from (select * replace (floor(o_totalprice) as o_totalprice) from orders)""",
)
def cast_conform(spark: SparkSession, d: str) -> DataFrame:
    target = T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("whole_price", T.LongType()),
        T.StructField("order_day", T.DateType()),
        T.StructField("price", T.DecimalType(12, 2)),
        T.StructField("priority_number", T.IntegerType()),
        T.StructField("priority", T.IntegerType()),
    ])
    price = F.floor("o_totalprice").cast("double")
    return (
        table(spark, d, "orders")
        .select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_orderdate").cast("date").alias("order_day"),
            price.cast("bigint").alias("whole_price"),
            price.cast("decimal(12,2)").alias("price"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
            F.col("o_orderpriority").try_cast("int").alias("priority_number"),
        )
        .to(target)
    )


@query(
    "nested_edit",
    """select c_custkey, c_name as inner_name, c_acctbal * 2 as doubled, c_mktsegment as first_tag,
              c_nationkey as nation, 'k' || c_nationkey as from_map from customer""",
)
def nested_edit(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "customer").select(
        "c_custkey",
        F.struct("c_name", "c_acctbal", F.col("c_nationkey").alias("nation"), F.lit(1).alias("spare")).alias("s"),
        F.array("c_mktsegment", F.lit("x")).alias("tags"),
        F.create_map(F.lit("code"), F.concat(F.lit("k"), F.col("c_nationkey").cast("string"))).alias("m"),
    )
    edited = nested.withColumn(
        "s", F.col("s").withField("doubled", F.col("s.c_acctbal") * 2).dropFields("spare", "c_acctbal")
    )
    return edited.select(
        "c_custkey", F.col("s").getField("c_name").alias("inner_name"), F.col("s.doubled").alias("doubled"),
        F.col("tags").getItem(0).alias("first_tag"), F.col("s.nation").alias("nation"),
        F.col("m").getItem("code").alias("from_map"),
    )


@query(
    "alias_transform",
    """select a.s_suppkey, a.s_acctbal, n.n_name, a.s_acctbal > 5000 as rich
       from supplier a join nation n on a.s_nationkey = n.n_nationkey""",
)
def alias_transform(spark: SparkSession, d: str) -> DataFrame:
    def flag_rich(df: DataFrame, limit: float) -> DataFrame:
        return df.withColumn("rich", F.col("s_acctbal") > limit)

    a = table(spark, d, "supplier").alias("a")
    n = table(spark, d, "nation").alias("n")
    return (
        a.join(n, F.col("a.s_nationkey") == F.col("n.n_nationkey"))
        .select(a.colRegex("`s_(suppkey|acctbal)`"), "n.n_name")
        .transform(flag_rich, 5000)
    )


def hash_fraction(seed: int, *cols: str):
    """Uniform number in [0, 1) fixed by the row id: samples do not depend on partitioning."""
    text = F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / 2**32


_FRACTION_SQL = "(('0x' || substr(md5('{seed}-' || event_id), 1, 8))::bigint / 4294967296.0::double)"


@query(
    "stratified_sample",
    f"""select event_id, event_type, value, case when {_FRACTION_SQL.format(seed=7)} < 0.8 then 'train' else 'test' end as part from events
      where {_FRACTION_SQL.format(seed=42)} < case event_type when 'purchase' then 0.5 when 'signup' then 0.25 when 'error' then 0.1 else 0.05 end""",
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Keeps a fixed share of each event type, and tags the kept rows with an 80/20 split."""
    # Share kept per event type.
    shares = {"purchase": 0.5, "signup": 0.25, "error": 0.1}
    share = F.coalesce(
        *[F.when(F.col("event_type") == kind, F.lit(kept)) for kind, kept in shares.items()], F.lit(0.05)
    )
    return (
        table(spark, d, "events")
        .filter(hash_fraction(42, "event_id") < share)
        .select(
            "event_id", "event_type", "value",
            F.when(hash_fraction(7, "event_id") < 0.8, "train").otherwise("test").alias("part"),
        )
    )


@query(
    "bernoulli_sample",
    """with n as (select event_type, count(*) as rows_there from events group by 1)
      select kind, event_type, rows_there, true as as_expected from n, (values ('bernoulli'), ('by_stratum'), ('split_70'), ('split_30')) k(kind)""",
)
def bernoulli_sample(spark: SparkSession, d: str) -> DataFrame:
    """The built-in samplers: Bernoulli, by stratum, and a random split, each number of kept rows held to six
    standard deviations around the asked share."""
    there = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("rows_there"))
    share = F.when(F.col("kind") == "bernoulli", 0.2).when(F.col("kind") == "split_70", 0.7).when(F.col("kind") == "split_30", 0.3)
    share = share.when(F.col("event_type") == "purchase", 0.5).when(F.col("event_type") == "click", 0.1).otherwise(0.0)
    kinds = F.explode(F.array(*[F.lit(k) for k in ("bernoulli", "by_stratum", "split_70", "split_30")])).alias("kind")
    grid = there.select("event_type", "rows_there", kinds).withColumn("share", share)
    met = grid.join(sample_counts(spark, d), ["kind", "event_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    room = 6 * F.sqrt(F.col("rows_there") * F.col("share") * (1 - F.col("share"))) + 1
    return met.select("kind", "event_type", "rows_there", (F.abs(F.col("n") - F.col("rows_there") * F.col("share")) <= room).alias("as_expected"))


def sample_counts(spark: SparkSession, d: str) -> DataFrame:
    """Kept rows per sampler and event type."""
    ev = table(spark, d, "events").select("event_id", "event_type")
    left, right = ev.randomSplit([0.7, 0.3], seed=42)
    parts = [
        ev.sample(fraction=0.2, seed=42).withColumn("kind", F.lit("bernoulli")),
        ev.sampleBy("event_type", {"purchase": 0.5, "click": 0.1}, seed=42).withColumn("kind", F.lit("by_stratum")),
        left.withColumn("kind", F.lit("split_70")),
        right.withColumn("kind", F.lit("split_30")),
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("kind", "event_type").agg(F.count("*").alias("n"))
