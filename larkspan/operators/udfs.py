"""User-defined functions: scalar, pandas, grouped, map, table functions, registration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.skew import blocks_of, salts
from larkspan.registry import query
from larkspan.sources.tables import table

GROUP_ROWS = 100_000


@query(
    "udf_scalar",
    """select o_orderkey, cast(substr(o_orderpriority, 1, 1) as int) as level, lower(substr(o_orderpriority, 3)) as label
       from orders""",
)
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    """Row functions in Python, moved in Arrow batches."""

    @F.udf("int", useArrow=True)
    def level(p: str) -> int:
        return int(p.split("-", 1)[0])

    label = F.udf(lambda p: p.split("-", 1)[1].lower(), "string", useArrow=True)
    return table(spark, d, "orders").select(
        "o_orderkey", level("o_orderpriority").alias("level"), label("o_orderpriority").alias("label"))


@query(
    "udf_pandas",
    """select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) as net,
              round(l_quantity / 50.0, 6) as scaled, round(l_extendedprice * l_tax, 4) as tax,
              upper(l_returnflag) || lower(l_linestatus) as code from lineitem""",
)
def udf_pandas(spark: SparkSession, d: str) -> DataFrame:
    """The four pandas shapes: series, iterator of series, iterator of several, series to frame."""

    @F.pandas_udf("double")
    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    @F.pandas_udf("double")
    def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for q in batches:
            yield q / 50.0

    @F.pandas_udf("double")
    def tax(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for price, rate in batches:
            yield price * rate

    @F.pandas_udf("flag string, status string")
    def codes(flag: pd.Series, status: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"flag": flag.str.upper(), "status": status.str.lower()})

    return (
        table(spark, d, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", net("l_extendedprice", "l_discount").alias("net"),
                scaled("l_quantity").alias("scaled"), tax("l_extendedprice", "l_tax").alias("tax"),
                codes("l_returnflag", "l_linestatus").alias("c"))
        .select("l_orderkey", "l_linenumber", "l_partkey", F.round("net", 4).alias("net"), F.round("scaled", 6).alias("scaled"),
                F.round("tax", 4).alias("tax"), F.concat("c.flag", "c.status").alias("code")))


@query(
    "udaf_pandas",
    """select event_type, round(sqrt(avg(value * value)), 6) as rms, count(*) as n from events group by 1""",
)
def udaf_pandas(spark: SparkSession, d: str) -> DataFrame:
    """A pandas aggregate. Python aggregates see their whole group at once, so each key is cut
    into blocks first and the partial results are combined."""

    @F.pandas_udf("double")
    def sum_squares(v: pd.Series) -> float:
        return float(np.square(v.to_numpy()).sum())

    ev = table(spark, d, "events").select("event_id", "event_type", "value")
    parts = blocks_of(ev, ["event_type"], ["event_id"], GROUP_ROWS).groupBy("event_type", "__block").agg(
        sum_squares("value").alias("ss"))
    sizes = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    return parts.groupBy("event_type").agg(F.sum("ss").alias("ss")).join(sizes, "event_type").select(
        "event_type", F.round(F.sqrt(F.col("ss") / F.col("n")), 6).alias("rms"), "n")


@query(
    "grouped_center",
    "select event_id, event_type, round(value - avg(value) over (partition by event_type), 6) as centered from events",
)
def grouped_center(spark: SparkSession, d: str) -> DataFrame:
    """Grouped map: the group mean is aggregated by Spark, the map runs on bounded blocks."""
    ev = table(spark, d, "events").select("event_id", "event_type", "value")
    means = ev.groupBy("event_type").agg(F.avg("value").alias("mean"))
    blocks = blocks_of(ev.join(means, "event_type"), ["event_type"], ["event_id"], GROUP_ROWS)

    def center(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(centered=pdf["value"] - pdf["mean"])[["event_id", "event_type", "centered"]]

    return blocks.groupBy("event_type", "__block").applyInPandas(
        center, "event_id bigint, event_type string, centered double"
    ).withColumn("centered", F.round("centered", 6))


@query(
    "map_filter_batches",
    """select doc_id, len(string_split_regex(trim(text), '\\s+')) as n_words from documents where lang = 'en'
       and n_chars > 500""",
)
def map_filter_batches(spark: SparkSession, d: str) -> DataFrame:
    """Map over Arrow batches: filter first in the scan, count words per batch."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pc.list_value_length(pc.split_pattern_regex(pc.utf8_trim_whitespace(b.column("text")), r"\s+"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), words.cast(pa.int64())], names=["doc_id", "n_words"])

    docs = table(spark, d, "documents").filter("lang = 'en' and n_chars > 500").select("doc_id", "text")
    return docs.mapInArrow(count_words, "doc_id bigint, n_words bigint")


@query(
    "map_pandas_batches",
    """select conv_id, turn, length(text) as chars, role = 'user' as from_user from conversations where role <> 'system'""",
)
def map_pandas_batches(spark: SparkSession, d: str) -> DataFrame:
    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["role"] != "system"]
            yield pd.DataFrame({"conv_id": b["conv_id"], "turn": b["turn"], "chars": b["text"].str.len(),
                                "from_user": b["role"] == "user"})

    return table(spark, d, "conversations").mapInPandas(shape, "conv_id bigint, turn bigint, chars bigint, from_user boolean")


@query(
    "udtf_split_words",
    """select item_id, lower(word) as word, count(*) as n from (
         select item_id, unnest(string_split(text, ' ')) as word from benchmark) where word <> '' group by all""",
)
def udtf_split_words(spark: SparkSession, d: str) -> DataFrame:
    """A table function in a lateral join: one output row per word."""

    @F.udtf(returnType="word string", useArrow=True)
    class ItemWords:
        def eval(self, text: str):
            yield from ((w,) for w in (text or "").lower().split(" ") if w)

    spark.udtf.register("larkspan_item_words", ItemWords)
    table(spark, d, "benchmark").createOrReplaceTempView("larkspan_items")
    return spark.sql(
        "select item_id, word, count(*) as n from larkspan_items, lateral larkspan_item_words(text) group by item_id, word")


@query(
    "udtf_dates",
    """select day, count(*) as n_open from (
         select unnest(generate_series(o_orderdate, o_orderdate + interval 2 day, interval 1 day))::date as day from orders
         where o_orderpriority = '1-URGENT') group by 1""",
)
def udtf_dates(spark: SparkSession, d: str) -> DataFrame:
    """Expands every urgent order into the three days it stays open."""
    from datetime import timedelta

    @F.udtf(returnType="day date", useArrow=True)
    class OpenDays:
        def eval(self, start, days: int):
            for i in range(days):
                yield (start + timedelta(days=i),)

    spark.udtf.register("open_days", OpenDays)
    table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").selectExpr(
        "cast(o_orderdate as date) as placed").createOrReplaceTempView("larkspan_urgent")
    return spark.sql("select day, count(*) as n_open from larkspan_urgent, lateral open_days(placed, 3) group by day")


@query(
    "udtf_count",
    "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by 1",
)
def udtf_count(spark: SparkSession, d: str) -> DataFrame:
    """Table argument with state: each partition reports once when it ends; Spark adds up.

    The partition key is segment plus a hash cut, so a huge segment is many partitions."""

    @F.udtf(returnType="segment string, n bigint, total double", useArrow=True)
    class Totals:
        def __init__(self):
            self.key, self.n, self.total = None, 0, 0.0

        def eval(self, row):
            self.key = row["c_mktsegment"]
            self.n += 1
            self.total += row["c_acctbal"]

        def terminate(self):
            yield (self.key, self.n, self.total)

    spark.udtf.register("segment_totals", Totals)
    table(spark, d, "customer").selectExpr(
        "c_mktsegment", "c_acctbal", f"pmod(xxhash64(c_custkey), {salts(table(spark, d, 'customer'))}) as cut").createOrReplaceTempView("larkspan_segments")
    return spark.sql("""
        select segment as c_mktsegment, sum(n) as n, round(sum(total), 2) as total
        from segment_totals(table(larkspan_segments) partition by (c_mktsegment, cut)) group by segment""")


@query(
    "udf_sql",
    """select n_name, replace(n_name, 'NATION_', 'N') as short_name, n_regionkey + 1 as next_region from nation""",
)
def udf_sql(spark: SparkSession, d: str) -> DataFrame:
    """Functions registered under a name, called from SQL and by name from the DataFrame API."""
    spark.udf.register("shorten_name", F.udf(lambda s: s.replace("NATION_", "N"), "string", useArrow=True))

    @F.pandas_udf("int")
    def add_one(v: pd.Series) -> pd.Series:
        return v + 1

    spark.udf.register("add_one", add_one)
    table(spark, d, "nation").createOrReplaceTempView("larkspan_nation")
    named = spark.sql("select n_name, n_regionkey, shorten_name(n_name) as short_name from larkspan_nation")
    return named.select("n_name", "short_name", F.call_udf("add_one", "n_regionkey").alias("next_region"))


@query(
    "udaf_average",
    """select user_id, round(avg(value), 9) as mean, count(*) as n, round(sum(value), 2) as total from events group by 1""",
)
def udaf_average(spark: SparkSession, d: str) -> DataFrame:
    """A user-defined average: buffers (sum, count) per block in pandas, merged and finished by Spark."""
    ev = table(spark, d, "events").select("event_id", "user_id", "value")
    schema = "user_id bigint, s double, n bigint"

    def buffers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.groupby("user_id")["value"].agg(s="sum", n="count").reset_index()

    return ev.select("user_id", "value").mapInPandas(buffers, schema).groupBy("user_id").agg(
        F.round(F.sum("s") / F.sum("n"), 9).alias("mean"), F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query(
    "vector_array",
    """select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as norm2,
              round(embedding[1]::double, 6) as first, len(embedding) as dims from embeddings""",
)
def vector_array(spark: SparkSession, d: str) -> DataFrame:
    """Array to ML vector and back."""
    v = table(spark, d, "embeddings").select(
        "vec_id", vector_to_array(array_to_vector(F.col("embedding").cast("array<double>"))).alias("a"))
    norm2 = F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x)
    return v.select("vec_id", F.round(norm2, 6).alias("norm2"), F.round(F.col("a")[0], 6).alias("first"),
                    F.size("a").cast("bigint").alias("dims"))
