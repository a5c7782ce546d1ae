"""Analysis of benchmark runs: speedups, balance, matrices, drift, findings, result files.

Events are read as work items of a run: the half of the month names the run, the user picks
model and chunk, the event type is the phase (views are the baseline), the value the seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.registry import query
from larkspan.session import scratch_path
from larkspan.sources.tables import table

# Phase names and the event type each is read from.
PHASES = {"baseline": "view", "phase1": "click", "phase2": "purchase", "phase3": "signup", "phase4": "error"}
BASE = "baseline"
MODELS, CHUNKS = 5, 8

ITEMS_SQL = f"""items as (select case when day(ts) <= 15 then 'run1' else 'run2' end as run, 'model_' || (user_id % {MODELS}) as model,
    case event_type {' '.join(f"when '{e}' then '{p}'" for p, e in PHASES.items())} end as phase, user_id % {CHUNKS} as partition_id,
    case when cast(json_extract_string(props, '$.k') as int) % 2 = 0 then 'cpu' else 'gpu' end as device, value as seconds from events),
  phases as (select model, phase, count(*) as samples, sum(seconds) as total_time, count(*) / sum(seconds) as throughput from items group by all)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    phase = F.coalesce(*[F.when(F.col("event_type") == e, p) for p, e in PHASES.items()])
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select(
        F.when(F.dayofmonth("ts") <= 15, "run1").otherwise("run2").alias("run"), F.concat(F.lit("model_"), (F.col("user_id") % MODELS).cast("string")).alias("model"),
        phase.alias("phase"), (F.col("user_id") % CHUNKS).alias("partition_id"), F.when(k % 2 == 0, "cpu").otherwise("gpu").alias("device"),
        F.col("value").alias("seconds"))


def phases(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """One row per model and phase: samples, seconds, samples per second."""
    t = items(spark, d).groupBy(*extra, "model", "phase").agg(F.count("*").alias("samples"), F.sum("seconds").alias("total_time"))
    return t.withColumn("throughput", F.col("samples") / F.col("total_time"))


def _base(value: str, *by: str) -> Column:
    """The baseline phase's value on every row of its model: groups have one row per phase."""
    return F.max(F.when(F.col("phase") == BASE, F.col(value))).over(Window.partitionBy(*(by or ("model",))))


@query(
    "speedup_vs_baseline",
    f"""with {ITEMS_SQL} select p.model, p.phase, round(p.throughput / b.throughput, 8) as speedup, round(b.total_time - p.total_time, 2) as seconds_saved
      from phases p join phases b on p.model = b.model and b.phase = '{BASE}' where p.phase <> '{BASE}'""",
)
def speedup_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    p = phases(spark, d).withColumns({"b_thr": _base("throughput"), "b_time": _base("total_time")})
    return p.filter(F.col("phase") != BASE).select(
        "model", "phase", F.round(F.col("throughput") / F.col("b_thr"), 8).alias("speedup"),
        F.round(F.col("b_time") - F.col("total_time"), 2).alias("seconds_saved"))


@query(
    "partition_balance",
    f"""with {ITEMS_SQL}, parts as (select model, phase, partition_id, count(*) as samples, sum(seconds) as t, list(distinct device) as devices from items group by all)
      select model, phase, count(*) as n_partitions, round(min(t), 2) as min_time, round(max(t), 2) as max_time, round(avg(t), 6) as avg_time,
        round(min(t) / max(t), 8) as balance, round(sum(samples / t), 8) as total_throughput,
        array_to_string(list_sort(list_distinct(flatten(list(devices)))), ',') as devices from parts group by all""",
)
def partition_balance(spark: SparkSession, d: str) -> DataFrame:
    """How even the chunks of a phase ran, and on which devices they were seen."""
    parts = items(spark, d).groupBy("model", "phase", "partition_id").agg(
        F.count("*").alias("samples"), F.sum("seconds").alias("t"), F.collect_set("device").alias("devices"))
    return parts.groupBy("model", "phase").agg(
        F.count("*").alias("n_partitions"), F.round(F.min("t"), 2).alias("min_time"), F.round(F.max("t"), 2).alias("max_time"),
        F.round(F.avg("t"), 6).alias("avg_time"), F.round(F.min("t") / F.max("t"), 8).alias("balance"),
        F.round(F.sum(F.col("samples") / F.col("t")), 8).alias("total_throughput"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("devices")))), ",").alias("devices"))


@query(
    "best_phase",
    f"""with {ITEMS_SQL}, s as (select p.*, p.throughput / b.throughput as speedup from phases p join phases b on p.model = b.model and b.phase = '{BASE}')
      select model, arg_max(phase, throughput) as best_phase, round(max(throughput), 8) as best_throughput, round(max(speedup), 8) as best_speedup,
        round(min(total_time), 2) as best_time, round(max(total_time) filter (phase = '{BASE}') - min(total_time), 2) as time_saved,
        max(speedup) = max(max(speedup)) over () as is_best_model from s group by 1""",
)
def best_phase(spark: SparkSession, d: str) -> DataFrame:
    s = phases(spark, d).withColumn("speedup", F.col("throughput") / _base("throughput"))
    per_model = s.groupBy("model").agg(
        F.max_by("phase", "throughput").alias("best_phase"), F.round(F.max("throughput"), 8).alias("best_throughput"), F.max("speedup").alias("sp"),
        F.round(F.min("total_time"), 2).alias("best_time"),
        F.round(F.max(F.when(F.col("phase") == BASE, F.col("total_time"))) - F.min("total_time"), 2).alias("time_saved"))
    # One row per model: a short list.
    overall = F.max("sp").over(Window.partitionBy(F.lit(1)))
    return per_model.select("model", "best_phase", "best_throughput", F.round("sp", 8).alias("best_speedup"), "best_time", "time_saved",
                            (F.col("sp") == overall).alias("is_best_model"))


@query(
    "phase_matrix",
    f"""with {ITEMS_SQL} select model, {', '.join(f"round(max(throughput) filter (phase = '{p}'), 8) as {p}_throughput, round(max(total_time) filter (phase = '{p}'), 2) as {p}_time, left(md5((max(samples) filter (phase = '{p}'))::varchar), 8) as {p}_hash" for p in PHASES)}
      from phases group by 1""",
)
def phase_matrix(spark: SparkSession, d: str) -> DataFrame:
    """One row per model, one group of columns per phase."""
    return phases(spark, d).groupBy("model").pivot("phase", list(PHASES)).agg(
        F.round(F.max("throughput"), 8).alias("throughput"), F.round(F.max("total_time"), 2).alias("time"),
        F.left(F.md5(F.max("samples").cast("string")), F.lit(8)).alias("hash"))


@query(
    "mode_efficiency",
    f"""with {ITEMS_SQL}, t as (select model as mode, run as data_type, sum(seconds) filter (phase in ('baseline', 'phase1')) as train_time,
          sum(seconds) filter (phase = 'phase2') as infer_time, count(*) filter (phase in ('baseline', 'phase1')) as n_train, count(*) filter (phase = 'phase2') as n_test,
          max(seconds) filter (phase = 'phase3') as peak_after, max(seconds) as peak_any, avg((device = 'cpu')::int) as accuracy from items group by all)
      select mode, data_type, round(n_train * 5 / greatest(train_time, 0.001), 6) as train_throughput, round(n_test / greatest(infer_time, 0.001), 8) as inference_throughput,
        coalesce(peak_after, peak_any, 0) as peak_memory, round(accuracy, 8) as accuracy, round(accuracy / coalesce(peak_after, peak_any, 0), 10) as accuracy_per_mb from t""",
)
def mode_efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Training and inference rates, peak memory from whichever field is present, accuracy."""
    epochs = 5
    train, infer = F.col("phase").isin(BASE, "phase1"), F.col("phase") == "phase2"
    t = items(spark, d).groupBy(F.col("model").alias("mode"), F.col("run").alias("data_type")).agg(
        F.sum(F.when(train, F.col("seconds"))).alias("train_time"), F.sum(F.when(infer, F.col("seconds"))).alias("infer_time"),
        F.count_if(train).alias("n_train"), F.count_if(infer).alias("n_test"), F.max(F.when(F.col("phase") == "phase3", F.col("seconds"))).alias("peak_after"),
        F.max("seconds").alias("peak_any"), F.avg((F.col("device") == "cpu").cast("double")).alias("acc"))
    peak = F.coalesce("peak_after", "peak_any", F.lit(0.0))
    return t.select(
        "mode", "data_type", F.round(F.col("n_train") * epochs / F.greatest("train_time", F.lit(0.001)), 6).alias("train_throughput"),
        F.round(F.col("n_test") / F.greatest("infer_time", F.lit(0.001)), 8).alias("inference_throughput"), peak.alias("peak_memory"),
        F.round("acc", 8).alias("accuracy"), F.round(F.col("acc") / peak, 10).alias("accuracy_per_mb"))


@query(
    "overhead_drift",
    f"""with {ITEMS_SQL}, r as (select run, model, count(*) filter (phase = 'baseline') / sum(seconds) filter (phase = 'baseline') as base,
          count(*) filter (phase = 'phase1') / sum(seconds) filter (phase = 'phase1') as p1 from items group by all)
      select a.model, round((a.base / a.p1 - 1) * 100, 6) as overhead_pct_run1, round((b.base / b.p1 - 1) * 100, 6) as overhead_pct_run2,
        round((b.base - a.base) / a.base * 100, 6) as baseline_drift_pct, round((b.p1 - a.p1) / a.p1 * 100, 6) as phase1_drift_pct
      from r a join r b on a.model = b.model and a.run = 'run1' and b.run = 'run2'""",
)
def overhead_drift(spark: SparkSession, d: str) -> DataFrame:
    """Cost of distribution against the baseline within a run, and change between runs."""
    wide = phases(spark, d, "run").groupBy("model").pivot("run", ["run1", "run2"]).agg(
        F.max(F.when(F.col("phase") == BASE, F.col("throughput"))).alias("base"), F.max(F.when(F.col("phase") == "phase1", F.col("throughput"))).alias("p1"))
    pct = lambda a, b: F.round((F.col(a) / F.col(b) - 1) * 100, 6)
    change = lambda c: F.round((F.col(f"run2_{c}") - F.col(f"run1_{c}")) / F.col(f"run1_{c}") * 100, 6)
    return wide.select("model", pct("run1_base", "run1_p1").alias("overhead_pct_run1"), pct("run2_base", "run2_p1").alias("overhead_pct_run2"),
                       change("base").alias("baseline_drift_pct"), change("p1").alias("phase1_drift_pct"))


@query(
    "findings",
    f"""with {ITEMS_SQL}, s as (select p.model, p.phase, p.samples, p.throughput / b.throughput as speedup, b.samples as base_samples
          from phases p join phases b on p.model = b.model and b.phase = '{BASE}')
      select 'all_reproducible' as rule, (bool_and(samples = base_samples))::varchar as finding from s
      union all select 'cpu_reproducible', (bool_and(samples = base_samples))::varchar from s where phase = 'phase1'
      union all select 'slower_than_baseline', coalesce(string_agg(model, ',' order by model), '') from s where phase = 'phase1' and speedup < 1
      union all select 'best_speedup', arg_max(model, speedup) from s where phase = 'phase2' and speedup > 1""",
)
def findings(spark: SparkSession, d: str) -> DataFrame:
    """Conclusions drawn by rule from the speedups and agreement of all models."""
    s = phases(spark, d).withColumns({"speedup": F.col("throughput") / _base("throughput"), "base_samples": _base("samples")})
    same = F.bool_and(F.col("samples") == F.col("base_samples")).cast("string")
    slower = F.array_join(F.sort_array(F.collect_list(F.when(F.col("speedup") < 1, F.col("model")))), ",")
    rules = [
        s.agg(same.alias("finding")).withColumn("rule", F.lit("all_reproducible")),
        s.filter("phase = 'phase1'").agg(same.alias("finding")).withColumn("rule", F.lit("cpu_reproducible")),
        s.filter("phase = 'phase1'").agg(slower.alias("finding")).withColumn("rule", F.lit("slower_than_baseline")),
        s.filter("phase = 'phase2' and speedup > 1").agg(F.max_by("model", "speedup").alias("finding")).withColumn("rule", F.lit("best_speedup")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.select("rule", "finding")


def write_results(spark: SparkSession, d: str) -> str:
    """Result documents, one per run: model to phase to figures, with a side key to skip."""
    path = scratch_path(spark, "results")
    figure = F.struct("throughput", "total_time", F.col("samples").alias("num_samples"),
                      F.when((F.col("model") == "model_4") & (F.col("phase") == "phase4"), "failed").alias("error"),
                      F.when((F.col("model") == "model_3") & (F.col("phase") == "phase3"), True).alias("skipped"))
    per_model = phases(spark, d, "run").groupBy("run", "model").agg(
        F.map_from_entries(F.collect_list(F.struct("phase", figure.alias("figures")))).alias("phases"))
    doc = per_model.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("model", "phases"))).alias("models"))
    side = F.create_map(F.lit("_comparison"), F.element_at(F.map_values("models"), 1))
    doc.select(F.to_json(F.map_concat("models", side)).alias("value"), F.concat(F.lit("2026010"), F.right("run", F.lit(1)), F.lit("_120000")).alias("stamp")).write.partitionBy(
        "stamp").text(path)
    return path


_LONG_SQL = f"""with {ITEMS_SQL}, rp as (select run, model, phase, count(*) as n, sum(seconds) as t from items group by all)
      select '2026010' || right(run, 1) || '_120000' as stamp, model, phase, round(n / t, 8) as throughput, round(t, 2) as total_time, n as num_samples from rp
      where not (model = 'model_4' and phase = 'phase4') and not (model = 'model_3' and phase = 'phase3')"""

_RESULT_TYPE = "map<string, map<string, struct<throughput: double, total_time: double, num_samples: bigint, error: string, skipped: boolean>>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested result files to one row per run, model and phase; side keys, errors and skipped
    phases are dropped."""
    docs = spark.read.schema("value string, stamp string").text(path).select("stamp", F.from_json("value", _RESULT_TYPE).alias("doc"))
    models = docs.select("stamp", F.explode("doc").alias("model", "phases")).filter(~F.col("model").startswith("_"))
    return models.select("stamp", "model", F.explode("phases").alias("phase", "r")).filter(
        F.col("r.error").isNull() & ~F.coalesce("r.skipped", F.lit(False))
    ).select("stamp", "model", "phase", F.round("r.throughput", 8).alias("throughput"), F.round("r.total_time", 2).alias("total_time"), "r.num_samples")


@query("results_long", _LONG_SQL)
def results_long(spark: SparkSession, d: str) -> DataFrame:
    return read_results(spark, write_results(spark, d))


@query("latest_run", f"select max(stamp) as latest, count(*) as n_rows from ({_LONG_SQL}) where stamp = '20260102_120000'")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The newest run by the time stamp in its file path, and how many results it holds."""
    path = write_results(spark, d)
    files = spark.read.text(path).select(F.regexp_extract("_metadata.file_path", r"stamp=(\d{8}_\d{6})", 1).alias("stamp"))
    latest = files.agg(F.max("stamp").alias("latest")).first()["latest"]
    return read_results(spark, path).filter(F.col("stamp") == latest).groupBy(F.col("stamp").alias("latest")).agg(F.count("*").alias("n_rows"))


@query(
    "results_sink",
    f"""with {ITEMS_SQL} select run, kind, count(*) as n_rows from (select run, unnest(['detail', 'summary']) as kind, model, phase from items group by run, model, phase) group by all""",
)
def results_sink(spark: SparkSession, d: str) -> DataFrame:
    """Detail as Parquet by run, summary as JSON by run; counted after reading both back."""
    path = scratch_path(spark, "report")
    p = phases(spark, d, "run")
    p.write.partitionBy("run").parquet(f"{path}/detail")
    p.select("run", "model", "phase", F.round("throughput", 2).alias("throughput")).write.partitionBy("run").json(f"{path}/summary")
    detail = spark.read.schema("model string, phase string, samples bigint, total_time double, throughput double, run string").parquet(f"{path}/detail")
    summary = spark.read.schema("model string, phase string, throughput double, run string").json(f"{path}/summary")
    both = detail.select("run", F.lit("detail").alias("kind")).unionByName(summary.select("run", F.lit("summary").alias("kind")))
    return both.groupBy("run", "kind").agg(F.count("*").alias("n_rows"))
