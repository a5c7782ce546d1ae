"""Landed samples lie in files of bounded size."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.streaming import sinks
from larkspan.streaming.runner import run


def test_samples_arrive_in_four_batches_of_bounded_files(spark, monkeypatch):
    path = []
    land = sinks.land
    monkeypatch.setattr(sinks, "land", lambda df, p: (path.append(p), land(df, p)))
    stream = sinks._land_stream(spark.range(1000), file_rows=30)
    files = spark.read.parquet(path[0]).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 36 and max(r["count"] for r in files) <= 60
    out = run(stream, "append").all()
    assert out.count() == 1000 and out.select("batch").distinct().count() == 4
