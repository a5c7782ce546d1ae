"""Streaming aggregates: words, time windows, sessions, late rows, page views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.registry import query
from larkspan.session import scratch_path, setting
from larkspan.sources.tables import SCHEMAS, table
from larkspan.streaming.runner import land, land_in_slices, land_marker, run, source, with_clock


def event_stream(spark: SparkSession, d: str, marker: bool = False) -> DataFrame:
    ev = table(spark, d, "events")
    path = land_in_slices(ev, "ts")
    if marker:
        land_marker(ev, path, "ts", user_id=-1, event_type="marker", value=0.0, event_id=-1)
    return source(spark, path, SCHEMAS["events"])


def file_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table without a clock, landed as files; as many as the shuffle has partitions."""
    path = scratch_path(spark, f"{name}-in")
    land(table(spark, d, name).repartition(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))), path)
    return source(spark, path, SCHEMAS[name])


WORDS = r"[ \n\t]+"
_WORDS_SQL = r"unnest(regexp_split_to_array(text, '[ \n\t]+'))"


@query("stream_scan", "select event_id, ts, user_id, event_type, value, props from events")
def stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """File source to file result, row by row the same table."""
    return run(event_stream(spark, d), "append").all().drop("batch")


@query(
    "stream_formats",
    "select f as format, count(*) as n, round(sum(value), 2) as total from events, (values ('csv'), ('json'), ('orc'), ('parquet'), ('text')) t(f) group by 1",
)
def stream_formats(spark: SparkSession, d: str) -> DataFrame:
    """The same rows through every streaming file format, always with a schema."""
    ev = table(spark, d, "events").select("event_id", "value")
    schema = "event_id bigint, value double"
    out = None
    for fmt in ("csv", "json", "orc", "parquet", "text"):
        path = scratch_path(spark, f"in-{fmt}")
        rows = ev.select(F.concat_ws(",", "event_id", "value").alias("value")) if fmt == "text" else ev
        rows.write.format(fmt).save(path)
        reader = spark.readStream.format(fmt)
        stream = reader.load(path) if fmt == "text" else reader.schema(schema).load(path)
        value = F.split_part("value", F.lit(","), F.lit(2)).cast("double") if fmt == "text" else F.col("value")
        agg = stream.groupBy(F.lit(fmt).alias("format")).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
        one = run(agg, "complete").last_batch()
        out = one if out is None else out.unionByName(one)
    return out.select("format", "n", F.round("s", 2).alias("total"))


@query("stream_wordcount", f"select word, count(*) as n from (select {_WORDS_SQL} as word from documents) where word <> '' group by 1")
def stream_wordcount(spark: SparkSession, d: str) -> DataFrame:
    words = file_stream(spark, d, "documents").select(F.explode(F.split("text", WORDS)).alias("word")).filter("word <> ''")
    return run(words.groupBy("word").agg(F.count("*").alias("n")), "update").latest("word")


@query(
    "stream_tumbling",
    """select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all""",
)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows, each written once when the watermark passes it."""
    ev = with_clock(event_stream(spark, d, marker=True))
    agg = ev.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return run(agg, "append").all().select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("s", 2).alias("total"))


@query(
    "stream_sliding",
    """select b + to_hours(h) as start, count(*) as n, round(max(value), 2) as top
       from (select time_bucket(interval 2 hour, ts) - interval 4 hour as b, ts, value from events), (values (0), (2), (4)) t(h)
       where ts >= b + to_hours(h) and ts < b + to_hours(h) + interval 6 hour group by 1""",
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour windows every two hours."""
    ev = with_clock(event_stream(spark, d, marker=True))
    agg = ev.groupBy(F.window("ts", "6 hours", "2 hours")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return run(agg, "append").all().select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("top", 2).alias("top"))


SESSIONS_SQL = """with m as (select *, case when ts - lag(ts) over w < interval 3 hour then 0 else 1 end as fresh from events
    window w as (partition by user_id order by ts)),
  s as (select *, sum(fresh) over (partition by user_id order by ts) as sid from m)"""


@query(
    "stream_session",
    SESSIONS_SQL + " select user_id, min(ts) as start, max(ts) + interval 3 hour as finish, count(*) as n, round(sum(value), 2) as total from s group by user_id, sid",
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    """Session windows with a three-hour gap. Sessions are first merged inside each input
    partition, which keeps a busy user's rows out of the shuffle."""
    with setting(spark, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"):
        return _sessions(spark, d)


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    ev = with_clock(event_stream(spark, d, marker=True))
    agg = ev.groupBy("user_id", F.session_window("ts", "3 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return run(agg, "append").all().filter("user_id >= 0").select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("finish"), "n",
        F.round("s", 2).alias("total"))


@query(
    "stream_late",
    """select cast(ts as date) as day, count(*) as n from events
       where not (event_type = 'error' and ts < (select min(ts)::date from events) + interval 10 day) group by 1""",
)
def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the first ten days arrive after the watermark has passed day nineteen: they
    are dropped. The stream stops and resumes between the two deliveries."""
    ev = table(spark, d, "events")
    start = ev.agg(F.min(F.col("ts").cast("date")).alias("a")).first()["a"]
    day = F.date_diff(F.col("ts").cast("date"), F.lit(start))
    late = (F.col("event_type") == "error") & (day < 10)
    path = scratch_path(spark, "late-in")
    counts = lambda: (
        with_clock(source(spark, path, SCHEMAS["events"], batches=1), delay="1 day").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")))
    land(ev.filter((day < 20) & ~late), path)
    stream = counts()
    sink = run(stream, "update")
    land(ev.filter((day >= 20) | late), path)
    run(counts(), "update", sink)
    return sink.latest("window").select(F.col("window.start").cast("timestamp_ntz").cast("date").alias("day"), "n")


@query(
    "stream_mod_counts",
    "select event_id % 10 as remainder, count(*) as n from events group by 1",
)
def stream_mod_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files queue up and are taken one after the other; counts by remainder."""
    mod = event_stream(spark, d).groupBy(F.pmod("event_id", F.lit(10)).alias("remainder")).agg(F.count("*").alias("n"))
    return run(mod, "complete").last_batch()


@query(
    "stream_pageviews",
    """select time_bucket(interval 1 day, ts) as start, user_id % 10 as zip, count(*) as views, count_if(event_type = 'error') as errors,
         round(count_if(event_type = 'error') / count(*), 8) as error_rate, count_if(c_custkey is not null) as known_users, max(user_id) as last_user
       from events left join customer on user_id = c_custkey and c_acctbal > 0 group by all""",
)
def stream_pageviews(spark: SparkSession, d: str) -> DataFrame:
    """Daily views per zip area: error rate, and how many views came from known customers."""
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    views = with_clock(event_stream(spark, d, marker=True)).join(known, "user_id", "left")
    agg = views.groupBy(F.window("ts", "1 day"), F.pmod("user_id", F.lit(10)).alias("zip")).agg(
        F.count("*").alias("views"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if("known").alias("known_users"),
        F.max("user_id").alias("last_user"))
    return run(agg, "append").all().select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), "zip", "views", "errors", F.round(F.col("errors") / F.col("views"), 8).alias("error_rate"),
        "known_users", "last_user")


@query(
    "stream_active_users",
    "select time_bucket(interval 1 day, ts) as start, count(distinct user_id) as active_users from events group by 1",
)
def stream_active_users(spark: SparkSession, d: str) -> DataFrame:
    """Exact active users per day: the stream keeps one row per user and day, counted on read."""
    ev = with_clock(event_stream(spark, d, marker=True))
    seen = ev.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"))
    return run(seen, "append").all().groupBy(F.col("window.start").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("active_users"))


@query("stream_grep", "select lang, count(*) as hits from documents where regexp_matches(text, '[0-9]{3}') group by 1")
def stream_grep(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a three-digit number, counted by language."""
    hits = file_stream(spark, d, "documents").filter(F.col("text").rlike("[0-9]{3}")).groupBy("lang").agg(F.count("*").alias("hits"))
    return run(hits, "complete").last_batch()
