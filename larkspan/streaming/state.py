"""Streams with keyed state: sessions kept by hand, running totals, duplicates, stream joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspan.operators.skew import micros
from larkspan.registry import query
from larkspan.session import scratch_path
from larkspan.sources.tables import SCHEMAS, table
from larkspan.streaming.runner import MARKER_USER, SLICES, WATERMARK, land, land_in_slices, run, source, with_clock
from larkspan.streaming.windows import SESSIONS_SQL, event_stream

GAP_MS = 3 * 3_600_000
END_EVENT = "purchase"


_PARTS = "user_id bigint, ts timestamp, first bigint, last bigint, n bigint, total double, ended boolean"
_OUT = "user_id bigint, first bigint, last bigint, n bigint, total double, reason string"
#: What a user's state holds: a list for each column of a part. Open sessions come first, ``n_open`` of them, then waiting events.
_KEPT = "first array<bigint>, last array<bigint>, n array<bigint>, total array<double>, ended array<boolean>, n_open int"
#: Events of a bucket, about: users share a call and a state, which each take far longer to pass to Python and back than a few events.
BUCKET_ROWS = 25_000


def _fold(gap_us: int):
    """Folds each Arrow batch to short sessions per user before the shuffle: a busy user then
    sends a few rows instead of every event. Right for gaps in any order of arrival, since
    overlapping short sessions simply join."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            b = b.sort_values(["user_id", "first"])
            fresh = (b["user_id"] != b["user_id"].shift()) | (b["first"] - b["first"].shift() >= gap_us)
            yield b.assign(part=fresh.cumsum()).groupby("part").agg(
                user_id=("user_id", "first"), ts=("ts", "max"), first=("first", "min"), last=("last", "max"), n=("n", "sum"),
                total=("total", "sum"), ended=("ended", "any"))

    return fold


def merge_sessions(parts: list[list], gap_us: int) -> list[list]:
    """Parts ``[first, last, n, total, ended]`` merged in time order: neighbours closer than the
    gap join, unless the earlier one was ended by its own event."""
    merged: list[list] = []
    for p in sorted(parts):
        if merged and not merged[-1][4] and p[0] - merged[-1][1] < gap_us:
            m = merged[-1]
            merged[-1] = [m[0], max(m[1], p[1]), m[2] + p[2], m[3] + p[3], p[4]]
        else:
            merged.append(list(p))
    return merged


def _settle(parts: list[list], waiting: list[list], watermark_us: int, gap_us: int, end_events: bool) -> tuple[list[list], list[list], list[list]]:
    """Open sessions, events still waiting, and closed sessions of one user.

    With end events the order of events matters, so an event takes part only once the watermark
    is past it and nothing earlier can arrive. Without them parts merge at once."""
    settled = [p for p in waiting if not end_events or p[0] <= watermark_us]
    waiting = [p for p in waiting if end_events and p[0] > watermark_us]
    open_, closed = [], []
    for s in merge_sessions(parts + settled, gap_us):
        (closed if s[4] or s[1] + gap_us <= watermark_us else open_).append(s)
    return open_, waiting, closed


def _keep_sessions(gap_us: int, end_events: bool):
    """State of a user: open sessions, and events the watermark has not passed yet."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *lists, n_open = state.get if state.exists else ([], [], [], [], [], 0)
        kept = [list(p) for p in zip(*lists)]
        parts, waiting = kept[:n_open], kept[n_open:]
        watermark_us = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for f in frames:
                waiting += [list(p) for p in zip(*(f[c].tolist() for c in ("first", "last", "n", "total", "ended")))]
        open_, waiting, closed = _settle(parts, waiting, watermark_us, gap_us, end_events)
        if open_ or waiting:
            state.update((*(list(c) for c in zip(*open_, *waiting)), len(open_)))
            due = min([s[1] + gap_us for s in open_] + [p[0] for p in waiting])
            state.setTimeoutTimestamp(max(int(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame({
                "user_id": key[0], "first": [int(s[0]) for s in closed], "last": [int(s[1]) for s in closed], "n": [int(s[2]) for s in closed],
                "total": [float(s[3]) for s in closed], "reason": ["event" if s[4] else "gap" for s in closed]})

    return step


def _keep_buckets(gap_us: int, end_events: bool):
    """The same for all users of a bucket at once: a state has a list of users, too, and is due when the first of them is."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *lists, n_open = state.get if state.exists else ([], [], [], [], [], [], 0)
        users: dict[int, tuple[list[list], list[list]]] = {}  # open sessions and waiting events of each
        for i, (user, *p) in enumerate(zip(*lists)):
            users.setdefault(user, ([], []))[i >= n_open].append(p)
        watermark_us = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for f in frames:
                for user, *p in zip(*(f[c].tolist() for c in ("user_id", "first", "last", "n", "total", "ended"))):
                    users.setdefault(user, ([], []))[1].append(p)
        open_, waiting, closed = [], [], []
        for user, (parts, events) in users.items():
            for kept, found in zip((open_, waiting, closed), _settle(parts, events, watermark_us, gap_us, end_events)):
                kept += [[user, *p] for p in found]
        if open_ or waiting:
            state.update((*(list(c) for c in zip(*open_, *waiting)), len(open_)))
            due = min([s[2] + gap_us for s in open_] + [p[1] for p in waiting])
            state.setTimeoutTimestamp(max(int(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame({
                "user_id": [s[0] for s in closed], "first": [int(s[1]) for s in closed], "last": [int(s[2]) for s in closed], "n": [int(s[3]) for s in closed],
                "total": [float(s[4]) for s in closed], "reason": ["event" if s[5] else "gap" for s in closed]})

    return step


def stateful_sessions(spark: SparkSession, d: str, end_event: str | None) -> DataFrame:
    gap_us = GAP_MS * 1000
    ended = F.col("event_type") == end_event if end_event else F.lit(False)
    t = micros("ts")
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(table(spark, d, "events").count() / BUCKET_ROWS))
    # rows without a user move the clock as others do and are left out with the marker
    parts = event_stream(spark, d, marker=True).select(
        F.coalesce("user_id", F.lit(MARKER_USER)).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), t.alias("first"), t.alias("last"), F.lit(1).cast("bigint").alias("n"),
        F.col("value").alias("total"), ended.alias("ended"))
    if end_event is None:
        parts = parts.mapInPandas(_fold(gap_us), _PARTS)
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    out = parts.withWatermark("ts", WATERMARK).groupBy("bucket").applyInPandasWithState(
        _keep_buckets(gap_us, end_event is not None), _OUT, f"user_id array<bigint>, {_KEPT}", "append", GroupStateTimeout.EventTimeTimeout)
    return run(out, "append").all().filter("user_id >= 0").select(
        "user_id", F.timestamp_micros("first").cast("timestamp_ntz").alias("start"), F.timestamp_micros("last").cast("timestamp_ntz").alias("finish"),
        "n", F.round("total", 2).alias("total"), "reason")


@query(
    "stream_state_session",
    SESSIONS_SQL + " select user_id, min(ts) as start, max(ts) as finish, count(*) as n, round(sum(value), 2) as total, 'gap' as reason from s group by user_id, sid",
)
def stream_state_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions kept in state by hand and released by event-time timeout."""
    return stateful_sessions(spark, d, None)


@query(
    "stream_complex_session",
    f"""with m as (select *, case when ts - lag(ts) over w < interval 3 hour and lag(event_type) over w <> '{END_EVENT}' then 0 else 1 end as fresh from events
      window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by user_id order by ts) as sid from m)
    select user_id, min(ts) as start, max(ts) as finish, count(*) as n, round(sum(value), 2) as total,
      case when arg_max(event_type, ts) = '{END_EVENT}' then 'event' else 'gap' end as reason from s group by user_id, sid""",
)
def stream_complex_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions closed by a gap or by an explicit end event."""
    return stateful_sessions(spark, d, END_EVENT)


@query("stream_dedup", "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event is delivered, the first slice twice; ids seen within the watermark are dropped."""
    ev = table(spark, d, "events")
    path = land_in_slices(ev, "ts")
    land_in_slices(ev.filter("event_type in ('click', 'error')"), "ts", path, slices=1)
    stream = with_clock(source(spark, path, SCHEMAS["events"]), delay="60 days").dropDuplicatesWithinWatermark(["event_id"])
    return run(stream.select("event_id", "event_type", "value"), "append").all().groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("stream_dedup_keys", "select distinct user_id, event_type from events")
def stream_dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    """First sight of each user and event type; state is one entry per pair."""
    pairs = event_stream(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return run(pairs, "append").all().drop("batch")


@query("stream_running_total", "select user_id, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_running_total(spark: SparkSession, d: str) -> DataFrame:
    """Running totals that start from a table: its sums are the stream's first batch and so its state; what arrives later adds on."""
    ev = table(spark, d, "events")
    start = ev.agg(F.min(F.col("ts").cast("date")).alias("a")).first()["a"]
    old = F.date_diff(F.col("ts").cast("date"), F.lit(start)) < 10
    history = ev.filter(old).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    live = ev.filter(~old).select("user_id", F.lit(1).cast("bigint").alias("n"), F.col("value").alias("s"), "ts")
    return continued_totals(history, live, "ts").select("user_id", "n", F.round("s", 2).alias("total"))


def continued_totals(history: DataFrame, live: DataFrame, ts: str, slices: int = SLICES) -> DataFrame:
    """``user_id, n, s``: the sums of ``history`` (one row a user) as the initial state of a stream over ``live``, which has the same columns and a clock.

    The first run of the query reads the history and stops; its checkpoint then holds a state for each user. The second run goes on from there
    with the live rows, so a user's state is one row, whether old, new or both. Null users are one user; values that are all null stay null.
    """
    spark = live.sparkSession
    path = scratch_path(spark, "totals-in")

    def totals(batches: int) -> DataFrame:
        return source(spark, path, history.schema, batches).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    land(history, path)
    sink = run(totals(1), "update")
    if not live.isEmpty():
        land_in_slices(live, ts, path, slices)
        run(totals(slices), "update", sink)
    return sink.latest("user_id")


@query(
    "stream_stream_join",
    """select c.event_id as click_id, p.event_id as purchase_id, c.user_id from events c join events p on c.user_id = p.user_id
       where c.event_type = 'click' and p.event_type = 'purchase' and p.ts >= c.ts and p.ts <= c.ts + interval 6 hour""",
)
def stream_stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within six hours of a click by the same user. Both sides carry a six-hour bin
    in the join key, so state of a busy user is spread and old bins leave with the watermark."""
    span = 6 * 3_600_000_000
    ev = event_stream(spark, d)
    t = micros("ts")
    clicks = with_clock(ev.filter("event_type = 'click'").select(
        F.col("event_id").alias("click_id"), F.col("user_id").alias("cu"), F.col("ts").alias("cts"),
        F.explode(F.sequence(F.floor(t / span), F.floor((t + span) / span))).alias("cb")), "cts")
    buys = with_clock(ev.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), F.col("user_id").alias("pu"), F.col("ts").alias("pts"), F.floor(t / span).alias("pb")), "pts")
    joined = clicks.join(
        buys, F.expr("cu = pu and cb = pb and pts >= cts and pts <= cts + interval 6 hours"))
    return run(joined.select("click_id", "purchase_id", F.col("cu").alias("user_id")), "append").all().drop("batch")


@query(
    "stream_recover",
    "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1",
)
def stream_recover(spark: SparkSession, d: str) -> DataFrame:
    """Stop after the first delivery, add files, start again from the checkpoint: nothing is
    lost and nothing counted twice."""
    ev = table(spark, d, "events")
    path = scratch_path(spark, "recover-in")

    def counts() -> DataFrame:
        return source(spark, path, SCHEMAS["events"], batches=1).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))

    land(ev.filter("event_type in ('view', 'click') or value < 20"), path)
    sink = run(counts(), "complete")
    land(ev.filter("not (event_type in ('view', 'click') or value < 20)"), path)
    run(counts(), "complete", sink)
    return sink.last_batch().select("event_type", "n", F.round("s", 2).alias("total"))
