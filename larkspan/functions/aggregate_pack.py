"""Aggregate functions, each called on a real column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.skew import drop_halo, ntile, null_safe_join, positions, ranks, with_halo
from larkspan.registry import query
from larkspan.sources.tables import table


@query(
    "fn_agg",
    """select l_linenumber, max(l_tax) as max_, min(l_tax) as min_, count(l_tax) as count_, round(sum(l_quantity), 2) as sum_,
         round(avg(l_quantity), 8) as avg_, round(avg(l_quantity), 8) as mean_, round(avg(l_quantity), 8) as try_avg_,
         round(sum(l_quantity), 2) as try_sum_, round(stddev_samp(l_quantity), 7) as std_, round(stddev_samp(l_quantity), 7) as stddev_,
         round(stddev_samp(l_quantity), 7) as stddev_samp_, round(stddev_pop(l_quantity), 7) as stddev_pop_,
         round(var_samp(l_quantity), 6) as variance_, round(var_samp(l_quantity), 6) as var_samp_, round(var_pop(l_quantity), 6) as var_pop_,
         round(regr_avgx(l_tax, l_quantity), 8) as regr_avgx_, round(regr_avgy(l_tax, l_quantity), 8) as regr_avgy_,
         regr_count(l_tax, l_quantity) as regr_count_, round(regr_intercept(l_tax, l_quantity), 8) as regr_intercept_,
         round(regr_r2(l_tax, l_quantity), 8) as regr_r2_, round(regr_slope(l_tax, l_quantity), 9) as regr_slope_,
         round(regr_sxx(l_tax, l_quantity), 3) as regr_sxx_, round(regr_sxy(l_tax, l_quantity), 6) as regr_sxy_,
         round(regr_syy(l_tax, l_quantity), 6) as regr_syy_, bool_and(l_quantity > 0) as every_, bool_and(l_quantity > 1) as bool_and_,
         bool_or(l_quantity > 49) as some_, bool_or(l_quantity > 50) as bool_or_, bit_and(l_orderkey) as bit_and_,
         bit_or(l_orderkey) as bit_or_, bit_xor(l_orderkey) as bit_xor_,
         round((avg(pow(l_quantity, 3)) - 3 * avg(l_quantity) * avg(l_quantity * l_quantity) + 2 * pow(avg(l_quantity), 3))
               / pow(var_pop(l_quantity), 1.5), 6) as skewness_, round(kurtosis_pop(l_quantity), 6) as kurtosis_,
         round(corr(l_quantity, l_tax), 8) as corr_, round(covar_pop(l_quantity, l_tax), 8) as covar_pop_,
         round(covar_samp(l_quantity, l_tax), 8) as covar_samp_, any_value(l_linenumber) as any_value_, any_value(l_linenumber) as first_,
         any_value(l_linenumber) as last_, any_value(l_linenumber) as first_value_, any_value(l_linenumber) as last_value_,
         count_if(l_returnflag = 'R') as count_if_, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) as max_by_,
         arg_min(l_orderkey, (l_extendedprice, l_orderkey)) as min_by_, round(sum(ln(1 + l_discount)), 6) as log_product_
       from lineitem group by 1""",
)
def fn_agg(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates that combine before the shuffle: safe on any group size."""
    q, t = "l_quantity", "l_tax"
    by_price = F.struct("l_extendedprice", "l_orderkey")
    qty = F.col(q)
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(
        F.max(t).alias("max_"), F.min(t).alias("min_"), F.count(t).alias("count_"), F.round(F.sum(q), 2).alias("sum_"),
        F.round(F.avg(q), 8).alias("avg_"), F.round(F.mean(q), 8).alias("mean_"), F.round(F.try_avg(q), 8).alias("try_avg_"),
        F.round(F.try_sum(q), 2).alias("try_sum_"), F.round(F.std(q), 7).alias("std_"), F.round(F.stddev(q), 7).alias("stddev_"),
        F.round(F.stddev_samp(q), 7).alias("stddev_samp_"), F.round(F.stddev_pop(q), 7).alias("stddev_pop_"),
        F.round(F.variance(q), 6).alias("variance_"), F.round(F.var_samp(q), 6).alias("var_samp_"),
        F.round(F.var_pop(q), 6).alias("var_pop_"), F.round(F.regr_avgx(t, q), 8).alias("regr_avgx_"),
        F.round(F.regr_avgy(t, q), 8).alias("regr_avgy_"), F.regr_count(t, q).alias("regr_count_"),
        F.round(F.regr_intercept(t, q), 8).alias("regr_intercept_"), F.round(F.regr_r2(t, q), 8).alias("regr_r2_"),
        F.round(F.regr_slope(t, q), 9).alias("regr_slope_"), F.round(F.regr_sxx(t, q), 3).alias("regr_sxx_"),
        F.round(F.regr_sxy(t, q), 6).alias("regr_sxy_"), F.round(F.regr_syy(t, q), 6).alias("regr_syy_"),
        F.every(qty > 0).alias("every_"), F.bool_and(qty > 1).alias("bool_and_"), F.some(qty > 49).alias("some_"),
        F.bool_or(qty > 50).alias("bool_or_"), F.bit_and("l_orderkey").alias("bit_and_"), F.bit_or("l_orderkey").alias("bit_or_"),
        F.bit_xor("l_orderkey").alias("bit_xor_"), F.round(F.skewness(q), 6).alias("skewness_"),
        F.round(F.kurtosis(q), 6).alias("kurtosis_"), F.round(F.corr(q, t), 8).alias("corr_"),
        F.round(F.covar_pop(q, t), 8).alias("covar_pop_"), F.round(F.covar_samp(q, t), 8).alias("covar_samp_"),
        F.any_value("l_linenumber").alias("any_value_"), F.first("l_linenumber").alias("first_"), F.last("l_linenumber").alias("last_"),
        F.first_value("l_linenumber").alias("first_value_"), F.last_value("l_linenumber").alias("last_value_"),
        F.count_if(F.col("l_returnflag") == "R").alias("count_if_"), F.max_by("l_orderkey", by_price).alias("max_by_"),
        F.min_by("l_orderkey", by_price).alias("min_by_"), F.round(F.sum(F.log(1 + F.col("l_discount"))), 6).alias("log_product_"),
    )


@query(
    "fn_agg_values",
    """with c as (select l_linenumber, l_quantity, count(*) as c from lineitem group by all),
            m as (select l_linenumber, arg_max(l_quantity, (c, -l_quantity)) as mode_ from c group by 1)
       select l.l_linenumber, round(quantile_cont(l_quantity, 0.3), 6) as percentile_, any_value(mode_) as mode_,
         array_to_string(list_sort(list(distinct l_quantity::int)), ',') as collect_set_, sum(distinct l_quantity) as sum_distinct_,
         count(distinct l_quantity) as count_distinct_, (select median(l_quantity) from c where c.l_linenumber = l.l_linenumber) as median_,
         (select round(product(l_quantity / 25), 9) from c where c.l_linenumber = l.l_linenumber) as product_,
         (select array_to_string(list_sort(list(c)), ',') from c where c.l_linenumber = l.l_linenumber) as collect_list_,
         (select array_to_string(list_sort(list(c)), ',') from c where c.l_linenumber = l.l_linenumber) as array_agg_
       from lineitem l join m on l.l_linenumber = m.l_linenumber group by 1""",
)
def fn_agg_values(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates that keep values: run on value counts, whose size is the number of distinct
    quantities and not the number of rows."""
    counts = table(spark, d, "lineitem").groupBy("l_linenumber", "l_quantity").agg(F.count("*").alias("c"))
    return counts.groupBy("l_linenumber").agg(
        F.round(F.percentile("l_quantity", 0.3, F.col("c")), 6).alias("percentile_"),
        F.max_by("l_quantity", F.struct(F.col("c"), -F.col("l_quantity"))).alias("mode_"),
        F.array_join(F.sort_array(F.collect_set(F.col("l_quantity").cast("int"))), ",").alias("collect_set_"),
        F.sum_distinct("l_quantity").alias("sum_distinct_"), F.count_distinct("l_quantity").alias("count_distinct_"),
        F.median("l_quantity").alias("median_"), F.round(F.product(F.col("l_quantity") / 25), 9).alias("product_"), F.array_join(F.sort_array(F.collect_list("c")), ",").alias("collect_list_"),
        F.array_join(F.sort_array(F.array_agg("c")), ",").alias("array_agg_"))


@query(
    "fn_sketch",
    """with u as (select l_linenumber, l_partkey as k from lineitem union select l_linenumber, l_suppkey from lineitem), c as (select l_linenumber, count(*) as either from u group by 1),
      m as (select l_linenumber, l_quantity as v, count(*) as n from lineitem group by all)
      select l_linenumber, count(distinct l_partkey) as parts, any_value(either) as parts_or_suppliers, true as approx_in_bound, true as hll_in_bound, true as union_in_bound,
        true as percentiles_in_bound, 4 as histogram_bins, (select min(v) from m where m.l_linenumber = li.l_linenumber and n = (select max(n) from m x where x.l_linenumber = li.l_linenumber)) as mode_
      from lineitem li join c using (l_linenumber) group by l_linenumber""",
)
def fn_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Sketches and other approximate aggregates, held to their error bounds by exact figures."""
    li = table(spark, d, "lineitem")
    s = sketch_functions(spark, d)
    keys = lambda *cols: F.explode(F.array(*cols)).alias("k")
    count = lambda out, *cols: li.select("l_linenumber", keys(*cols)).distinct().groupBy("l_linenumber").agg(F.count("*").alias(out))
    exact = count("parts", "l_partkey").join(count("parts_or_suppliers", "l_partkey", "l_suppkey"), "l_linenumber")
    ranks = li.join(F.broadcast(s.select("l_linenumber", "approx_percentile_", "percentile_approx_")), "l_linenumber").groupBy("l_linenumber").agg(*[
        ((F.avg((F.col("l_quantity") < F.col(c)).cast("double")) <= 0.51) & (F.avg((F.col("l_quantity") <= F.col(c)).cast("double")) >= 0.49)).alias(f"ok_{c}")
        for c in ("approx_percentile_", "percentile_approx_")])
    near = lambda c, to, e: F.abs(F.col(c) / F.col(to) - 1) <= e
    return s.join(exact, "l_linenumber").join(ranks, "l_linenumber").select(
        "l_linenumber", "parts", "parts_or_suppliers", near("approx_count_distinct_", "parts", 0.2).alias("approx_in_bound"),
        near("hll_sketch_estimate_", "parts", 0.08).alias("hll_in_bound"), near("hll_union_", "parts_or_suppliers", 0.08).alias("union_in_bound"),
        (F.col("ok_approx_percentile_") & F.col("ok_percentile_approx_")).alias("percentiles_in_bound"), "histogram_bins", "mode_")


def sketch_functions(spark: SparkSession, d: str) -> DataFrame:
    """The sketches and approximate figures themselves."""
    li = table(spark, d, "lineitem")
    agg = li.groupBy("l_linenumber").agg(
        F.approx_count_distinct("l_partkey").alias("approx_count_distinct_"),
        F.hll_sketch_agg("l_partkey").alias("by_part"), F.hll_sketch_agg("l_suppkey").alias("by_supp"),
        F.approx_percentile("l_quantity", 0.5, 1000).alias("approx_percentile_"),
        F.percentile_approx("l_quantity", F.lit(0.5), F.lit(1000)).alias("percentile_approx_"),
        F.histogram_numeric("l_quantity", F.lit(4)).alias("hist"),
        F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.9), F.lit(1)).alias("cms"),
        F.mode("l_quantity", deterministic=True).alias("mode_"))
    return agg.select(
        "l_linenumber", "approx_count_distinct_", F.hll_sketch_estimate("by_part").alias("hll_sketch_estimate_"),
        F.hll_sketch_estimate(F.hll_union("by_part", "by_supp")).alias("hll_union_"), "approx_percentile_", "percentile_approx_",
        F.size("hist").alias("histogram_bins"), F.octet_length("cms").alias("sketch_bytes"), "mode_")


@query(
    "fn_bitmap",
    "select l_linenumber, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts from lineitem group by 1",
)
def fn_bitmap(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct counts by bitmap: one bitmap per 32,768 keys, merged by OR."""
    li = table(spark, d, "lineitem")

    def distinct(col: str, out: str) -> DataFrame:
        per_flag = li.groupBy("l_linenumber", "l_returnflag", F.bitmap_bucket_number(col).alias("b")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(col)).alias("bits"))
        return per_flag.groupBy("l_linenumber", "b").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("c")).groupBy(
            "l_linenumber").agg(F.sum("c").alias(out))

    return distinct("l_suppkey", "suppliers").join(distinct("l_partkey", "parts"), "l_linenumber")


@query(
    "fn_window",
    """select o_orderkey, row_number() over w as row_number_, rank() over v as rank_, dense_rank() over v as dense_rank_,
         round(percent_rank() over v, 8) as percent_rank_, round(cume_dist() over v, 8) as cume_dist_, cast(ntile(3) over w as int) as ntile_,
         lag(o_totalprice, 1) over w as lag_, lead(o_totalprice, 1) over w as lead_,
         nth_value(o_totalprice, 2) over (partition by o_custkey order by o_orderdate, o_orderkey
           rows between unbounded preceding and unbounded following) as nth_value_
       from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey),
                          v as (partition by o_custkey order by o_orderpriority)""",
)
def fn_window(spark: SparkSession, d: str) -> DataFrame:
    """The nine window functions over each customer's orders, by the split forms: a customer may be too large for one task."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    key = ["o_custkey"]
    by_priority = ranks(o.select("o_orderkey", *key, "o_orderpriority"), key, "o_orderpriority", ["o_orderkey"]).select(
        "o_orderkey", F.col("rank").cast("int").alias("rank_"), F.col("dense_rank").cast("int").alias("dense_rank_"), F.round("percent_rank", 8).alias("percent_rank_"),
        F.round("cume_dist", 8).alias("cume_dist_"), "group_rows")
    placed = positions(o, key, ["o_orderdate", "o_orderkey"])
    second = placed.groupBy(*key).agg(F.max(F.when(F.col("row_pos") == 2, F.col("o_totalprice"))).alias("nth_value_"))
    w = Window.partitionBy(*key, "__block").orderBy("row_pos")
    moved = drop_halo(with_halo(placed, F.col("row_pos"), before=1, after=1, block=1_000_000)
                      .withColumns({"lag_": F.lag("o_totalprice").over(w), "lead_": F.lead("o_totalprice").over(w)}))
    return null_safe_join(moved, second, key).join(by_priority, "o_orderkey").select(
        "o_orderkey", F.col("row_pos").cast("int").alias("row_number_"), "rank_", "dense_rank_", "percent_rank_", "cume_dist_",
        ntile(F.col("row_pos"), F.col("group_rows"), 3).alias("ntile_"), "lag_", "lead_", "nth_value_")
