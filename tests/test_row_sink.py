"""The per-row sink counts a batch once, however often it runs."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from larkspan.streaming import sinks


def counted(totals):
    return {k: (n, round(total, 6)) for k, (n, total) in reduce(sinks._added, totals.value.values(), {}).items()}


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), tmp_path / "ckpt"
    rows = [("a" if i % 3 else "b", float(i)) for i in range(60)]
    schema = "event_type string, value double"
    for start in range(0, 60, 15):
        spark.createDataFrame(rows[start : start + 15], schema).repartition(3).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(folder)
    totals = spark.sparkContext.accumulator({}, sinks._Totals())
    sinks.feed_rows(stream, totals, str(checkpoint))
    want = {t: (sum(x == t for x, _ in rows), sum(v for x, v in rows if x == t)) for t in "ab"}
    assert counted(totals) == want
    commits = sorted((f for f in (checkpoint / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    assert len(commits) > 2
    # the batch has run, its commit is lost: it runs again
    last = commits[-1]
    last.unlink()
    Path(f"{last.parent}/.{last.name}.crc").unlink(missing_ok=True)
    sinks.feed_rows(stream, totals, str(checkpoint))
    assert last.exists()
    assert counted(totals) == want


def test_entries_stay_those_of_two_epochs():
    param, state = sinks._Totals(), {}
    for epoch in range(50):
        for part in range(4):
            state = param.addInPlace(state, {(epoch, part): {"a": (1, 2.0)}})
            state = param.addInPlace(state, {(epoch, part): {"a": (1, 2.0)}})
    assert len(state) <= 4 * 2 + 1
    assert reduce(sinks._added, state.values(), {}) == {"a": (200, 400.0)}
