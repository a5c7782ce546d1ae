"""State of streams: typed lists for sessions, totals that begin with a table."""

from __future__ import annotations

from larkspan.session import scratch_path
from larkspan.streaming import state
from larkspan.streaming.runner import land

ROWS = "user_id bigint, n bigint, s double"


def test_totals_go_on_from_their_history(spark):
    from datetime import datetime

    history = spark.createDataFrame([(1, 5, 10.0), (2, 3, 1.5), (None, 2, 4.0), (5, 2, None)], ROWS)
    live = spark.createDataFrame(
        [(1, 1, 1.0, datetime(2024, 1, d)) for d in range(1, 20)] + [(3, 1, None, datetime(2024, 1, 5)), (None, 1, 1.0, datetime(2024, 1, 9))], ROWS + ", ts timestamp_ntz")
    got = {r["user_id"]: (r["n"], r["s"]) for r in state.continued_totals(history, live, "ts").collect()}
    assert got == {1: (24, 29.0), 2: (3, 1.5), 3: (1, None), 5: (2, None), None: (3, 5.0)}
    alone = {r["user_id"]: (r["n"], r["s"]) for r in state.continued_totals(history, live.limit(0), "ts").collect()}
    assert alone == {1: (5, 10.0), 2: (3, 1.5), 5: (2, None), None: (2, 4.0)}
    fresh = {r["user_id"]: r["n"] for r in state.continued_totals(history.limit(0), live, "ts").collect()}
    assert fresh == {1: 19, 3: 1, None: 1}


def test_sessions_keep_typed_lists(monkeypatch):
    """The state of a user over two batches and a timeout, without a stream around it."""
    import pandas as pd

    class State:
        exists, hasTimedOut, value, watermark, due = False, False, None, 0, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.value, self.exists = value, True

        def remove(self):
            self.value, self.exists = None, False

        def getCurrentWatermarkMs(self):
            return self.watermark

        def setTimeoutTimestamp(self, at):
            self.due = at

    frame = lambda rows: pd.DataFrame(rows, columns=["first", "last", "n", "total", "ended"])
    step, kept = state._keep_sessions(10_000, end_events=True), State()
    assert list(step((7,), iter([frame([(1_000, 1_000, 1, 2.0, False), (5_000, 5_000, 1, 1.0, True)])]), kept)) == []
    assert kept.value == ([1_000, 5_000], [1_000, 5_000], [1, 1], [2.0, 1.0], [False, True], 0)
    kept.watermark = 3  # milliseconds: the first event is settled, the second waits; one in between ends the session
    assert list(step((7,), iter([frame([(3_000, 3_000, 1, 4.0, True)])]), kept))[0].values.tolist() == [[7, 1_000, 3_000, 2, 6.0, "event"]]
    assert kept.value == ([5_000], [5_000], [1], [1.0], [True], 0)
    kept.watermark, kept.hasTimedOut = kept.due, True
    assert list(step((7,), iter([]), kept))[0].values.tolist() == [[7, 5_000, 5_000, 1, 1.0, "event"]]
    assert not kept.exists


def test_land_adds_files(spark):
    path = scratch_path(spark, "land")
    for i in range(2):
        land(spark.range(3).selectExpr("id", f"{i} as slice"), path)
    assert spark.read.parquet(path).count() == 6


def test_users_of_a_bucket_share_a_call(spark, tmp_path, monkeypatch):
    """Sessions of many users, with ties, end events and rows without a user, from few calls: as many as there are buckets and batches, not users."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=37 * i), None if i % 50 == 0 else i % 400, "purchase" if i % 7 == 0 else "view", float(i % 9), "{}") for i in range(1200)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    calls, grouped = spark.sparkContext.accumulator(0), state._keep_buckets

    def counted(gap_us, end_events):
        step = grouped(gap_us, end_events)

        def one(key, frames, kept):
            calls.add(1)
            yield from step(key, frames, kept)

        return one

    monkeypatch.setattr(state, "_keep_buckets", counted)
    for end_event in (None, "purchase"):
        want = []
        for user in range(400):
            parts = [[int((r[1] - datetime(1970, 1, 1)).total_seconds()) * 10**6] * 2 + [1, r[4], r[3] == end_event] for r in rows if r[2] == user]
            want += [(user, s[0], s[1], s[2], s[3], "event" if s[4] else "gap") for s in state.merge_sessions(parts, state.GAP_MS * 1000)]
        calls.value = 0
        got = state.stateful_sessions(spark, str(tmp_path), end_event).collect()
        micros = lambda t: int((t - datetime(1970, 1, 1)).total_seconds()) * 10**6
        assert sorted((r["user_id"], micros(r["start"]), micros(r["finish"]), r["n"], r["total"], r["reason"]) for r in got) == sorted(want)
        assert 0 < calls.value < 200  # a call for each user and batch would be several hundred
