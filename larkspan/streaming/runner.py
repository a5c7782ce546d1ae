"""Running a stream over a table: the table is laid out as files that arrive in time order, the
query runs until all of them are read, and every micro-batch is written under its batch number.

A batch that is run again after a failure overwrites its own folder, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larkspan.session import scratch_path

SLICES = 3
# Longer than one slice, so that the order of files inside a slice does not matter.
WATERMARK = "15 days"
MARKER_USER = -1


def land(df: DataFrame, path: str) -> None:
    """Adds files to a stream's input folder."""
    df.write.mode("append").parquet(path)


def land_in_slices(df: DataFrame, ts: str, path: str | None = None, slices: int = SLICES) -> str:
    """Writes the rows slice by slice in time order: later slices are later files."""
    path = path or scratch_path(df.sparkSession, "stream-in")
    low, high = df.agg(F.min(F.unix_date(F.col(ts).cast("date"))), F.max(F.unix_date(F.col(ts).cast("date")))).first()
    step = max(1, math.ceil((high - low + 1) / slices))
    day = F.unix_date(F.col(ts).cast("date"))
    for i in range(slices):
        land(df.filter((day >= low + i * step) & (day < low + (i + 1) * step)), path)
    return path


def land_marker(df: DataFrame, path: str, ts: str, **values) -> None:
    """One row far in the future moves the watermark past everything, so that all windows and
    sessions close. Its own window never closes and is never seen."""
    last = df.agg(F.max(ts).alias(ts)).select((F.col(ts) + F.expr("interval 60 days")).alias(ts))
    row = last.select(*[
        F.col(ts) if f.name == ts else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    land(row, path)


def source(spark: SparkSession, path: str, schema: T.StructType | str, batches: int = 4) -> DataFrame:
    """A file stream that takes the files in about ``batches`` steps."""
    n_files = len(spark.read.schema(schema).parquet(path).inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, n_files // batches)).parquet(path)


def with_clock(df: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Event time with a watermark; the zone-less column becomes an instant of the session zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


class Sink:
    """Folder of micro-batch results."""

    def __init__(self, spark: SparkSession, schema: T.StructType, name: str = "stream"):
        self.spark, self.schema = spark, schema
        self.out, self.checkpoint = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")

    def all(self) -> DataFrame:
        """Every row of every batch: the result of an append query."""
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(schema).option("basePath", self.out).parquet(self.out)

    def last_batch(self) -> DataFrame:
        """The newest batch that wrote anything: the result of a complete query."""
        rows = self.all()
        newest = rows.agg(F.max("batch")).first()[0]
        return rows.filter(F.col("batch") == newest).drop("batch")

    def latest(self, *keys: str) -> DataFrame:
        """The newest row of each key: the result of an update query."""
        values = [f.name for f in self.schema.fields if f.name not in keys]
        return self.all().groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")


def run(df: DataFrame, mode: str, sink: Sink | None = None, each: Callable[[DataFrame, int], None] | None = None) -> Sink:
    """Runs a streaming frame over everything that has arrived, then stops."""
    sink = sink or Sink(df.sparkSession, df.schema)
    query: StreamingQuery = (
        df.writeStream.outputMode(mode).option("checkpointLocation", sink.checkpoint)
        .trigger(availableNow=True).foreachBatch(each or sink.write).start())
    query.awaitTermination()
    return sink
