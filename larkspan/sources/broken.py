"""Text files with broken records: the good rows with their types, the others whole in a quarantine table with the file they came from."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.skew import blocks_of, micros
from larkspan.registry import query
from larkspan.session import scratch_path, write_table
from larkspan.sources.tables import SCHEMAS, table

RECORD, FILE = "__record", "__file"


class Checked(NamedTuple):
    """``good`` has the columns of the schema; ``bad`` has ``record``, the text as it stood in the file, and ``file``."""

    good: DataFrame
    bad: DataFrame

    def accept(self, share: float) -> DataFrame:
        """The good rows, if at most ``share`` of all records are broken."""
        good, bad = self.good.count(), self.bad.count()
        if bad > share * (good + bad):
            raise ValueError(f"{bad} of {good + bad} records are broken, more than a share of {share}")
        return self.good


def read_checked(spark: SparkSession, path: str | list[str], fmt: str, schema: str, required: list[str] | None = None, **options) -> Checked:
    """Reads ``csv`` or ``json`` and parts the records that do not fit ``schema``: values that do not convert, too few or too many fields, text
    that is no JSON. With ``required`` also rows that parse but have a null there; their record is the row as JSON.

    The files are parsed once, into a table that both parts are read from: good and bad rows together are the records of the input, one
    each, whatever their order. Blank lines are no records. With ``multiLine`` a broken CSV record is a record, but a broken JSON file counts as one
    record, since its parser cannot find the next. Nothing to read gives two empty tables.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"format {fmt!r} has no broken records to part; csv and json have")
    wanted = spark.createDataFrame([], schema).schema
    kept = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, **options}
    if kept["mode"] != "PERMISSIVE" or RECORD in wanted.names or FILE in wanted.names:
        raise ValueError(f"mode must be left out, and no column may be called {RECORD} or {FILE}")
    rows = spark.read.format(fmt).schema(wanted.add(RECORD, "string")).options(**kept).load(path)
    columns = [c for c in rows.columns if c != RECORD]
    # a scan that asks for the record alone would parse nothing: the table holds all columns
    parsed = write_table(rows.select("*", F.col("_metadata.file_path").alias(FILE)), f"checked-{fmt}")
    lacks = F.lit(False)
    for c in required or []:
        lacks = lacks | F.col(c).isNull()
    broken = F.col(RECORD).isNotNull() | lacks
    bad = parsed.where(broken).select(F.coalesce(F.col(RECORD), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("record"), F.col(FILE).alias("file"))
    return Checked(parsed.where(~broken).select(*columns), bad)


def read_strict(spark: SparkSession, path: str | list[str], fmt: str, schema: str, **options) -> DataFrame:
    """The job fails on the first broken record."""
    return spark.read.format(fmt).schema(schema).options(mode="FAILFAST", **options).load(path)


def read_lenient(spark: SparkSession, path: str | list[str], fmt: str, schema: str, **options) -> DataFrame:
    """Broken records are left out. A scan of fewer columns parses, and so checks, only those: all are asked for here, by a table."""
    return write_table(spark.read.format(fmt).schema(schema).options(mode="DROPMALFORMED", **options).load(path), f"lenient-{fmt}")


_ORDER = "k bigint, customer bigint, status string, cents bigint, placed date"


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as delimited lines; by their key some have a word for a number, a field too few or too many, or no such day."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    line = lambda *parts: F.concat_ws(";", key.cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), *parts)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(key % 11 == 3, line(F.lit("much"), day)).when(key % 13 == 5, line(cents)).when(key % 17 == 7, line(cents, day, F.lit("more")))
        .when(key % 19 == 2, line(cents, F.lit("2024-13-41"))).otherwise(line(cents, day)))
    return table(spark, d, "orders").select(text.alias("value"))


def _both(checked: Checked, good: dict[str, Column]) -> DataFrame:
    names = [*good, "record"]
    one = checked.good.select(*[c.alias(n) for n, c in good.items()], F.lit(None).cast("string").alias("record"))
    return one.unionByName(checked.bad.select("record"), allowMissingColumns=True).select(*names)


_LINES = """lines as (select o_orderkey as k, o_custkey as customer, o_orderstatus as status, cast(round(o_totalprice * 100) as bigint) as cents, cast(o_orderdate as date) as placed,
         concat_ws(';', o_orderkey, o_custkey, o_orderstatus) as head from orders),
       told as (select *, case when k % 11 = 3 then head || ';much;' || placed when k % 13 = 5 then head || ';' || cents
         when k % 17 = 7 then head || ';' || cents || ';' || placed || ';more' when k % 19 = 2 then head || ';' || cents || ';2024-13-41' end as record from lines)"""


@query(
    "csv_quarantine",
    f"""with {_LINES} select case when record is null then k end as k, case when record is null then cents end as cents, case when record is null then placed end as placed, record from told""",
)
def csv_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Delimited lines, some of them broken: good rows typed, bad ones as they stood, one row for each line."""
    path = scratch_path(spark, "broken-csv")
    _order_lines(spark, d).write.text(path, compression="gzip")
    checked = read_checked(spark, path, "csv", _ORDER, sep=";", dateFormat="yyyy-MM-dd")
    return _both(checked, {c: F.col(c) for c in ("k", "cents", "placed")})


@query("csv_lenient", f"with {_LINES} select status, count(*) as n, sum(cents)::bigint as cents, count(distinct customer) as n_customers from told where record is null group by 1")
def csv_lenient(spark: SparkSession, d: str) -> DataFrame:
    """The same lines with broken ones left out, checked in every column although the result needs three."""
    path = scratch_path(spark, "lenient-csv")
    _order_lines(spark, d).write.text(path)
    rows = read_lenient(spark, path, "csv", _ORDER, sep=";", dateFormat="yyyy-MM-dd")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.count_distinct("customer").alias("n_customers"))


@query(
    "json_quarantine",
    """with told as (select event_id, user_id, event_type, epoch_us(ts) as t,
         case when event_id % 7 = 1 then '{"event_id":' || event_id || ',"user":{"id":' || user_id
           when event_id % 7 = 2 then '{"event_id":"' || event_type || '","user":{"id":' || user_id || '},"t":' || epoch_us(ts) || '}'
           when event_id % 7 = 3 then event_type || ' at ' || epoch_us(ts)
           when event_id % 7 = 4 then '{"event_id":' || event_id || ',"user":null,"t":' || epoch_us(ts) || '}' end as record from events)
       select case when record is null then event_id end as event_id, case when record is null then user_id end as user_id, case when record is null then t end as t, record from told""",
)
def json_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines that end early, hold a word for a number, are no JSON, or lack a field that must be there."""
    path = scratch_path(spark, "broken-json")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    i, u, t, kind = F.col("event_id"), F.col("user_id"), micros("ts"), F.col("event_type")
    value = (
        F.when(i % 7 == 1, text('{"event_id":', i, ',"user":{"id":', u)).when(i % 7 == 2, text('{"event_id":"', kind, '","user":{"id":', u, '},"t":', t, "}"))
        .when(i % 7 == 3, text(kind, " at ", t)).when(i % 7 == 4, text('{"event_id":', i, ',"user":null,"t":', t, "}"))
        .otherwise(text('{"event_id":', i, ',"user":{"id":', u, '},"t":', t, "}")))
    table(spark, d, "events").select(value.alias("value")).write.text(path, compression="gzip")
    checked = read_checked(spark, path, "json", "event_id bigint, user struct<id: bigint>, t bigint", ["user"])
    return _both(checked, {"event_id": F.col("event_id"), "user_id": F.col("user.id"), "t": F.col("t")})


#: Records of a multi-line file, which one task must read as a whole.
FILE_ROWS = 20_000
#: Records of a JSON array, which is one value.
ARRAY_ROWS = 1_000


@query(
    "csv_multiline",
    """select doc_id, length(text) as chars, length(text) - length(replace(text, chr(10), '')) as breaks, length(text) - length(replace(text, '"', '')) as quotes,
              md5(text) as digest, lang, n_chars from documents""",
)
def csv_multiline(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with line breaks, separators and quotes inside their fields, read back by a schema from files of bounded size."""
    path = scratch_path(spark, "multiline-csv")
    fmt = {"header": True, "escape": '"', "quoteAll": True, "emptyValue": "", "nullValue": "\\N", "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, d, "documents").write.options(maxRecordsPerFile=FILE_ROWS, **fmt).csv(path)
    back = read_strict(spark, path, "csv", SCHEMAS["documents"], multiLine=True, maxCharsPerColumn=-1, **fmt)
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c)))
    return back.select("doc_id", F.length("text").alias("chars"), count("\n").alias("breaks"), count('"').alias("quotes"), F.md5("text").alias("digest"), "lang", "n_chars")


@query(
    "json_multiline",
    """select conv_id, count(*) as n_turns, coalesce(sum(length(text)), 0)::bigint as chars,
              count(*) filter (role = 'user') as n_user, coalesce(sum(length(text) - length(replace(text, chr(10), ''))), 0)::bigint as breaks
       from conversations group by 1""",
)
def json_multiline(spark: SparkSession, d: str) -> DataFrame:
    """Pretty-printed JSON whose records span lines: an array of a bounded number of records in each file, read by a multi-line scan."""
    path = scratch_path(spark, "multiline-json")
    cut = blocks_of(table(spark, d, "conversations"), [], ["conv_id", "turn"], ARRAY_ROWS)
    arrays = cut.groupBy("__block").agg(F.collect_list(F.struct("conv_id", "role", "text")).alias("rows"))
    record = F.to_json("rows", {"pretty": "true", "ignoreNullFields": "false"})
    arrays.select(record.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    back = read_strict(spark, path, "json", "conv_id bigint, role string, text string", multiLine=True)
    return back.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(F.col("role") == "user").alias("n_user"),
        F.coalesce(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n")))), F.lit(0)).alias("breaks"))
