"""Work per micro-batch: upserts, lookups, SQL, progress metrics, models that learn as data arrives."""

from __future__ import annotations

import math
import time
import uuid
from functools import reduce

import numpy as np
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from larkspan.operators.skew import top_per_group
from larkspan.plans.scoring import samples
from larkspan.plans.training import Adam, logistic_gradient, summed_gradient, two_classes
from larkspan.registry import query
from larkspan.session import TABLE_PREFIX, scratch_path
from larkspan.sources.tables import table
from larkspan.streaming.runner import Sink, land, run, source
from larkspan.streaming.windows import WORDS, event_stream, file_stream


@query("stream_upsert", "select user_id, arg_max(event_type, ts) as last_type, max(ts) as last_seen, arg_max(value, ts) as last_value from events group by 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Latest row per user. Each batch writes its own newest rows under its number; a batch run
    twice replaces itself, and readers take the newest row of each key."""
    ev = event_stream(spark, d).select("user_id", "event_type", "value", "ts", "event_id")
    sink = Sink(spark, ev.schema, "upsert")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value", "ts", "event_id"), F.struct("ts", "event_id")).alias("r"))
        sink.write(newest.select("user_id", "r.*"), batch_id)

    run(ev, "append", sink, upsert)
    newest = F.max_by(F.struct("event_type", "ts", "value"), F.struct("ts", "event_id"))
    return sink.all().groupBy("user_id").agg(newest.alias("r")).select(
        "user_id", F.col("r.event_type").alias("last_type"), F.col("r.ts").alias("last_seen"), F.col("r.value").alias("last_value"))


_BY_TYPE_SQL = "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1"


def _by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("stream_file_sink", _BY_TYPE_SQL)
def stream_file_sink(spark: SparkSession, d: str) -> DataFrame:
    """A named stream into partitioned files: the sink's own log makes every batch count once, also after a restart in between."""
    out, checkpoint = scratch_path(spark, "file-sink"), scratch_path(spark, "file-sink-ckpt")
    stream = event_stream(spark, d).select("event_id", "event_type", "value")
    for _ in range(2):  # the second run finds nothing new
        q = (stream.writeStream.queryName("larkspan_file_sink").format("parquet").partitionBy("event_type").outputMode("append")
             .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    return _by_type(spark.read.schema("event_id bigint, value double, event_type string").parquet(out))


@query("stream_table_sink", _BY_TYPE_SQL)
def stream_table_sink(spark: SparkSession, d: str) -> DataFrame:
    """A stream into a partitioned catalog table, on a processing-time trigger."""
    name = f"{TABLE_PREFIX}stream_{uuid.uuid4().hex[:12]}"
    stream = event_stream(spark, d).select("event_id", "event_type", "value")
    q = (stream.writeStream.queryName(name).partitionBy("event_type").outputMode("append").option("path", scratch_path(spark, "table-sink"))
         .option("checkpointLocation", scratch_path(spark, "table-sink-ckpt")).trigger(processingTime="0 seconds").toTable(name, format="parquet"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return _by_type(spark.table(name))


class _Totals(AccumulatorParam):
    """Counts and sums by name, kept by epoch and partition: what comes again takes the place of what was there. A stream only repeats its last epoch,
    so those before the last two are added up under one key and the number of entries stays that of two epochs."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802
        a.update(b)
        newest = max((epoch for epoch, _ in a), default=0)
        for key in [k for k in a if k != _SETTLED and k[0] < newest - 1]:
            a[_SETTLED] = _added(a.get(_SETTLED, {}), a.pop(key))
        return a


_SETTLED = (-1, -1)


def _added(a: dict[str, tuple[int, float]], b: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    out = dict(a)
    for name, (n, total) in b.items():
        m, before = out.get(name, (0, 0.0))
        out[name] = (m + n, before + total)
    return out


class RowTotals:
    """A per-row sink: opened for each partition of a batch, fed row by row, closed once. What a partition has seen is handed over under its epoch and
    number when it closes without an error."""

    def __init__(self, totals):
        self.totals = totals

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self.key, self.seen = (epoch_id, partition_id), {}
        return True

    def process(self, row) -> None:
        n, total = self.seen.get(row["event_type"], (0, 0.0))
        self.seen[row["event_type"]] = (n + 1, total + row["value"])

    def close(self, error) -> None:
        if error is None:
            self.totals.add({self.key: self.seen})


def feed_rows(stream: DataFrame, totals, checkpoint: str) -> None:
    """All that has arrived since the checkpoint, row by row into ``totals``."""
    q = (stream.select("event_type", "value").writeStream.foreach(RowTotals(totals)).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


@query("stream_row_sink", _BY_TYPE_SQL)
def stream_row_sink(spark: SparkSession, d: str) -> DataFrame:
    """Every row through a writer with open, process and close. A batch that runs again replaces itself while this application lives and deals
    files out as before; across applications use a sink that writes by batch, as ``stream_upsert`` does."""
    totals = spark.sparkContext.accumulator({}, _Totals())
    feed_rows(event_stream(spark, d), totals, scratch_path(spark, "row-sink-ckpt"))
    by_type = reduce(_added, totals.value.values(), {})
    rows = [(k, n, round(total, 2)) for k, (n, total) in by_type.items()]
    return spark.createDataFrame(rows, "event_type string, n bigint, total double")


_SPLIT = r"unnest(regexp_split_to_array(text, '[ \n\t]+'))"


@query(
    "stream_lookup",
    f"""with lex as (select word, count(*) % 5 - 2 as score from (select {_SPLIT} as word from benchmark) where word <> '' group by 1),
      w as (select role, {_SPLIT} as word from conversations)
      select * from (select role, word, cast(sum(score) as bigint) as total, count(*) as n from w join lex using (word) group by all)
      qualify row_number() over (partition by role order by total desc, word) <= 10""",
)
def stream_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Words of a stream scored by a static word table; the ten best words per speaker."""
    words = lambda df, *cols: df.select(*cols, F.explode(F.split("text", WORDS)).alias("word")).filter("word <> ''")
    lexicon = words(table(spark, d, "benchmark")).groupBy("word").agg((F.count("*") % 5 - 2).alias("score"))
    spoken = words(file_stream(spark, d, "conversations"), "role").join(lexicon, "word")
    scored = spoken.groupBy("role", "word").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    latest = run(scored, "update").latest("role", "word")
    return top_per_group(latest, ["role"], [F.desc("total"), F.asc("word")], ["word"], 10).select("role", "word", "total", "n")


@query(
    "stream_sql",
    "select event_type, count(*) as n, max(value) as top from events where value > 10 group by 1",
)
def stream_sql(spark: SparkSession, d: str) -> DataFrame:
    """SQL over each micro-batch; the per-batch figures add up."""
    ev = event_stream(spark, d).select("event_type", "value")
    sink = Sink(spark, spark.createDataFrame([], "event_type string, n bigint, top double").schema, "sql")

    def summarise(batch: DataFrame, batch_id: int) -> None:
        batch.createOrReplaceTempView("larkspan_batch")
        sink.write(batch.sparkSession.sql(
            "select event_type, count(*) as n, max(value) as top from larkspan_batch where value > 10 group by event_type"), batch_id)

    run(ev, "append", sink, summarise)
    return sink.all().groupBy("event_type").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


class Progress(StreamingQueryListener):
    """Keeps one record per finished micro-batch."""

    def __init__(self):
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows.append((str(p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0.0)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


@query("stream_metrics", "select origin, count(*) as input_rows, true as every_batch from events, (values ('query'), ('listener')) t(origin) group by origin")
def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rows read by a stream as its own progress tells them and as a listener heard them, and whether both have every batch up to the last."""
    rows, last = stream_progress(spark, d)
    return rows.groupBy("origin").agg(F.sum("input_rows").alias("input_rows"), (F.count_distinct("batch_id") == last + 1).alias("every_batch"))


def stream_progress(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Progress of every micro-batch, from the query itself and from a listener, and the number of the last one. The listener stays until it
    has heard of that."""
    stream = event_stream(spark, d).groupBy("event_type").count()
    sink, listener = Sink(spark, stream.schema, "metrics"), Progress()
    spark.streams.addListener(listener)
    try:
        q = (stream.writeStream.outputMode("update").option("checkpointLocation", sink.checkpoint).trigger(availableNow=True)
             .foreachBatch(sink.write).start())
        q.awaitTermination()
        own = [("query", p["batchId"], p["numInputRows"], float(p["processedRowsPerSecond"] or 0.0)) for p in q.recentProgress]
        last = max(b for _, b, _, _ in own)
        until = time.monotonic() + 60
        while not any(i == str(q.id) and b == last for i, b, _, _ in listener.rows):
            if time.monotonic() > until:
                raise TimeoutError("the listener was not told of the last batch")
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(listener)
    heard = [("listener", b, n, r) for i, b, n, r in listener.rows if i == str(q.id)]
    rows = spark.createDataFrame(own + heard, "origin string, batch_id bigint, input_rows bigint, rows_per_second double")
    return rows.dropDuplicates(["origin", "batch_id"]), last


def _cells(batch: DataFrame) -> tuple[float, ...]:
    x, y = F.col("x"), F.col("y")
    return tuple(v or 0.0 for v in batch.agg(
        F.count("*").cast("double"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y), F.sum(y * y)).first())


@query(
    "stream_linreg",
    """select round(regr_slope(value, k), 8) as slope, round(regr_intercept(value, k), 7) as intercept, count(*) as n
       from (select value, cast(json_extract_string(props, '$.k') as double) as k from events)""",
)
def stream_linreg(spark: SparkSession, d: str) -> DataFrame:
    """Least squares from streamed sums; each batch writes its sums, so a retry cannot count twice."""
    ev = event_stream(spark, d).select(F.from_json("props", "k double")["k"].alias("x"), F.col("value").alias("y"))
    schema = "n double, sx double, sy double, sxx double, sxy double, syy double"
    sink = Sink(spark, spark.createDataFrame([], schema).schema, "linreg")
    run(ev, "append", sink, lambda b, i: sink.write(spark.createDataFrame([_cells(b)], schema), i))
    t = sink.all().agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") ** 2)
    return t.select(F.round(slope, 8).alias("slope"), F.round((F.col("sy") - slope * F.col("sx")) / F.col("n"), 7).alias("intercept"),
                    F.col("n").cast("bigint").alias("n"))


@query(
    "stream_ab_test",
    """with s as (select user_id % 2 as arm, count(*) as n, avg(value) as m, var_samp(value) as v from events group by 1)
       select a.n as n_a, b.n as n_b, round(a.m, 8) as mean_a, round(b.m, 8) as mean_b,
         round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) as t_value,
         round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) as degrees
       from s a join s b on a.arm = 0 and b.arm = 1""",
)
def stream_ab_test(spark: SparkSession, d: str) -> DataFrame:
    """Welch's t of two arms from streamed count, sum and sum of squares."""
    ev = event_stream(spark, d).groupBy(F.pmod("user_id", F.lit(2)).alias("arm")).agg(
        F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    arms = {r["arm"]: r for r in run(ev, "complete").last_batch().collect()}

    def moments(r) -> tuple[int, float, float]:
        return r["n"], r["s"] / r["n"], (r["ss"] - r["s"] ** 2 / r["n"]) / (r["n"] - 1)

    (na, ma, va), (nb, mb, vb) = moments(arms[0]), moments(arms[1])
    ea, eb = va / na, vb / nb
    t, df = (ma - mb) / math.sqrt(ea + eb), (ea + eb) ** 2 / (ea**2 / (na - 1) + eb**2 / (nb - 1))
    return spark.createDataFrame([(na, nb, round(ma, 8), round(mb, 8), round(t, 6), round(df, 4))],
                                 "n_a bigint, n_b bigint, mean_a double, mean_b double, t_value double, degrees double")


#: Rows of a landed file, about: a task that writes or keeps one holds some 40 MB of samples.
FILE_ROWS = 250_000


def _land_stream(rows: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """Rows dealt out to files of bounded size, which arrive in four batches."""
    path = scratch_path(rows.sparkSession, "samples-in")
    land(rows.repartition(4 * max(1, math.ceil(rows.count() / (4 * file_rows)))), path)
    return source(rows.sparkSession, path, rows.schema)


@query("stream_logreg")
def stream_logreg(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression that takes a few optimizer steps on every micro-batch."""
    stream = _land_stream(two_classes(spark, d))
    model: dict = {"theta": None, "adam": None, "history": []}

    def learn(batch: DataFrame, batch_id: int) -> None:
        if model["theta"] is None:
            head = batch.select(F.size("x").alias("n")).first()
            if head is None:
                return
            model["theta"], model["adam"] = np.zeros(head["n"] + 1), Adam(head["n"] + 1, 0.1)
        batch = batch.persist()
        for _ in range(5):
            g, loss, hits, n = summed_gradient(batch, model["theta"], logistic_gradient())
            model["theta"] = model["adam"].step(model["theta"], g / n)
        model["history"].append((batch_id, float(loss / n), float(hits / n), n))
        batch.unpersist()

    run(stream, "append", Sink(spark, stream.schema, "logreg"), learn)
    return spark.createDataFrame(model["history"], "batch bigint, loss double, accuracy double, n_rows bigint")


@query("stream_kmeans")
def stream_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Centres that move with every micro-batch: old weight halves, new sums come in."""
    stream, k, decay = _land_stream(samples(spark, d).select("x")), 5, 0.5
    model: dict = {"centres": None, "weight": np.zeros(k), "history": []}

    def learn(batch: DataFrame, batch_id: int) -> None:
        if model["centres"] is None:
            rows = batch.orderBy(F.xxhash64("x")).limit(k).collect()
            model["centres"] = np.array([r["x"] for r in rows])
        shared = spark.sparkContext.broadcast(model["centres"])

        def assign(frames):
            import pandas as pd

            for f in frames:
                if len(f):
                    x, c = np.stack(f["x"].to_numpy()), shared.value
                    dist = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
                    near = dist.argmin(axis=1)
                    for i in np.unique(near):
                        vec = np.concatenate([x[near == i].sum(axis=0), [(near == i).sum(), dist[near == i, i].sum()]])
                        yield pd.DataFrame({"k": int(i), "idx": np.arange(vec.size), "v": vec})

        sums = np.zeros((k, model["centres"].shape[1] + 2))
        for r in batch.select("x").mapInPandas(assign, "k int, idx int, v double").groupBy("k", "idx").agg(F.sum("v").alias("v")).collect():
            sums[r["k"], r["idx"]] = r["v"]
        old = model["weight"] * decay
        weight = old + sums[:, -2]
        moved = weight > 0
        model["centres"][moved] = (model["centres"][moved] * old[moved, None] + sums[moved, :-2]) / weight[moved, None]
        model["weight"] = weight
        model["history"].append((batch_id, float(sums[:, -1].sum()), int(sums[:, -2].sum())))

    run(stream, "append", Sink(spark, stream.schema, "kmeans"), learn)
    return spark.createDataFrame(model["history"], "batch bigint, cost double, n_rows bigint")
