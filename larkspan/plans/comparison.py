"""Comparison of runs: the same data scored in four modes, compared pair by pair.

A mode differs only in the precision of its weights, so modes agree closely but not exactly.
Per mode there is a training curve (the model at growing sharpness), a held-out accuracy, a
model hash and a predictions hash, for two kinds of data.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.skew import top_per_group
from larkspan.plans.scoring import (
    CELLS_SQL,
    evaluate,
    hash_tree,
    hash_tree_sql,
    linear_scorer,
    logits_by_join,
    parameters,
    samples,
    softmax,
    top1,
    weights,
)
from larkspan.registry import query
from larkspan.session import cut_lineage, write_table

# Modes with the decimals their weights keep, and the epochs compared.
MODES = {"cluster_cpu": 9, "cluster_gpu": 2, "local_cpu": 12, "local_gpu": 3}
EPOCHS = 5
# Tolerance per kind of pair (absolute, relative, match rate, loss and accuracy difference).
TIERS = {
    "self": (0.0, 0.0, 1.0, 0.0, 0.0),
    "same_device": (1e-5, 1e-4, 0.99, 0.05, 0.02),
    "cross_device": (1e-4, 1e-3, 0.95, 0.15, 0.05),
}
MISMATCHES_SHOWN = 20


def pair_kind(a: str = "mode_a", b: str = "mode_b") -> Column:
    device = lambda m: F.substring_index(m, "_", -1)
    return (
        F.when(F.col(a) == F.col(b), "self").when(device(a) == device(b), "same_device").otherwise("cross_device"))


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, *v) for k, v in TIERS.items()],
        "pair_kind string, atol double, rtol double, match_rate_limit double, loss_limit double, accuracy_limit double")


def mode_scores(spark: SparkSession, d: str) -> DataFrame:
    """``mode, data_type, vec_id, label, classes, logits``: one pass scores every mode, as the
    weights of all modes stacked in one matrix."""
    params = cut_lineage(parameters(spark, d))
    held = weights(params)
    kind = F.when(F.col("label") < 5, "structured").otherwise("unstructured").alias("data_type")
    if held is None:
        out = [
            logits_by_join(samples(spark, d), params.withColumn("value", F.round("value", n))).withColumn("mode", F.lit(m))
            for m, n in MODES.items()]
        return reduce(DataFrame.unionByName, out).select("mode", kind, "vec_id", "label", "classes", "logits")
    labels, w = held
    stacked = np.vstack([np.round(w, n) for n in MODES.values()])
    classes = F.array(*[F.lit(int(v)) for v in labels])
    scored = samples(spark, d).select("vec_id", "label", kind, linear_scorer(spark, stacked)("x").alias("all_logits"))
    per_mode = F.array(*[
        F.struct(F.lit(m).alias("mode"), F.slice("all_logits", i * len(labels) + 1, len(labels)).alias("logits")) for i, m in enumerate(MODES)])
    return scored.select("vec_id", "label", "data_type", F.inline(per_mode)).select(
        "mode", "data_type", "vec_id", "label", classes.alias("classes"), "logits")


def pairs_of(df: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """Every pair of modes of the same key, the smaller name first.

    One shuffle puts the few modes of a key side by side in one row; the pairs are then taken
    inside that row. A row that only one side has stays visible.
    """
    modes = sorted(MODES)
    wide = df.groupBy(*on).agg(
        *[F.first(F.when(F.col("mode") == m, F.struct(*cols)), ignorenulls=True).alias(m) for m in modes])
    pairs = F.array(*[
        F.struct(F.lit(a).alias("mode_a"), F.lit(b).alias("mode_b"), F.col(a).alias("a"), F.col(b).alias("b"))
        for i, a in enumerate(modes) for b in modes[i + 1:]])
    both = wide.select(*on, F.explode(pairs).alias("p")).filter("p.a is not null or p.b is not null")
    return both.select(
        *on, "p.mode_a", "p.mode_b", *[F.col(f"p.a.{c}").alias(f"{c}_a") for c in cols], *[F.col(f"p.b.{c}").alias(f"{c}_b") for c in cols],
        F.col("p.a").isNotNull().alias("in_a"), F.col("p.b").isNotNull().alias("in_b"),
    ).withColumn("pair_kind", pair_kind())


_MODES_SQL = ", ".join(f"('{m}', {n})" for m, n in MODES.items())
_TIERS_SQL = ", ".join(f"('{k}', {', '.join(repr(x) + '::double' for x in v)})" for k, v in TIERS.items())
RUNS_SQL = f"""{CELLS_SQL.split('scores as')[0].rstrip().rstrip(',')},
  modes(mode, digits) as (values {_MODES_SQL}),
  tiers(pair_kind, atol, rtol, match_rate_limit, loss_limit, accuracy_limit) as (values {_TIERS_SQL}),
  wts as (select mode, k, j, round(w, digits) as w from params, modes),
  scores as (select mode, vec_id, any_value(label) as label, k, sum(x * w) as logit from cells join wts using (j) group by mode, vec_id, k),
  probs as (select *, case when label < 5 then 'structured' else 'unstructured' end as data_type,
    exp(logit - max(logit) over v) / sum(exp(logit - max_logit)) over v as p from (select *, max(logit) over (partition by mode, vec_id) as max_logit from scores)
    window v as (partition by mode, vec_id)),
  preds as (select mode, data_type, vec_id, any_value(label) as label, arg_max(k, logit) as prediction from probs group by all),
  pairs as (select a.mode as mode_a, b.mode as mode_b,
    case when a.mode = b.mode then 'self' when split_part(a.mode, '_', 2) = split_part(b.mode, '_', 2) then 'same_device' else 'cross_device' end as pair_kind
    from modes a join modes b on a.mode < b.mode)"""
RUNS_SQL = RUNS_SQL.replace(
    "exp(logit - max(logit) over v) / sum(exp(logit - max_logit)) over v", "exp(logit - max_logit) / sum(exp(logit - max_logit)) over v")


@query(
    "tolerance_tiers",
    f"""with modes(mode) as (values {', '.join(f"('{m}')" for m in MODES)}),
      tiers(pair_kind, atol, rtol, match_rate_limit, loss_limit, accuracy_limit) as (values {_TIERS_SQL}),
      p as (select a.mode as mode_a, b.mode as mode_b, case when a.mode = b.mode then 'self'
            when split_part(a.mode, '_', 2) = split_part(b.mode, '_', 2) then 'same_device' else 'cross_device' end as pair_kind
            from modes a join modes b on a.mode <= b.mode)
      select p.*, atol, rtol, match_rate_limit, loss_limit, accuracy_limit, (select count(*) from embeddings) as n_rows from p join tiers using (pair_kind)""",
)
def tolerance_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tier of every pair of modes that scored the samples; order of the two does not matter."""
    counts = mode_scores(spark, d).groupBy("mode").agg(F.count("*").alias("n_rows"))
    return _mode_pairs(counts).join(tiers(spark), "pair_kind").select(
        "mode_a", "mode_b", "pair_kind", "atol", "rtol", "match_rate_limit", "loss_limit", "accuracy_limit", "n_rows")


def _mode_pairs(per_mode: DataFrame) -> DataFrame:
    """Pairs, self included, of a table with one row per mode."""
    a = per_mode.select(F.col("mode").alias("mode_a"), "n_rows")
    b = per_mode.select(F.col("mode").alias("mode_b"))
    return a.join(b, F.col("mode_a") <= F.col("mode_b")).withColumn("pair_kind", pair_kind())


@query(
    "compare_predictions",
    f"""with {RUNS_SQL}, m as (select mode_a, mode_b, pair_kind, a.vec_id, a.prediction = b.prediction as same from pairs
          join preds a on a.mode = mode_a join preds b on b.mode = mode_b and b.vec_id = a.vec_id)
      select mode_a, mode_b, count(*) as total, count_if(same) as matching, 0 as missing, round(avg(same::int), 8) as match_rate,
        any_value(match_rate_limit) as threshold, avg(same::int) >= any_value(match_rate_limit) as passed,
        coalesce(array_to_string((list(vec_id order by vec_id) filter (not same))[1:{MISMATCHES_SHOWN}], ','), '') as first_mismatches
      from m join tiers using (pair_kind) group by all""",
)
def compare_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Match rate of two modes against the limit of their tier, and the first differing rows."""
    # Written once: the totals and the list of differing rows both read it.
    preds = write_table(mode_scores(spark, d).select("mode", "vec_id", top1().alias("prediction")), "mode-predictions")
    both = pairs_of(preds, ["vec_id"], ["prediction"]).withColumn("same", F.coalesce(F.col("prediction_a") == F.col("prediction_b"), F.lit(False)))
    total = both.groupBy("mode_a", "mode_b", "pair_kind").agg(
        F.count("*").alias("total"), F.count_if("same").alias("matching"),
        F.count_if(~F.col("in_a") | ~F.col("in_b")).cast("int").alias("missing"))
    shown = top_per_group(both.filter("not same"), ["mode_a", "mode_b"], [F.asc("vec_id")], ["vec_id"], MISMATCHES_SHOWN).groupBy(
        "mode_a", "mode_b").agg(F.array_join(F.sort_array(F.collect_list("vec_id")), ",").alias("first_mismatches"))
    rate = F.col("matching") / F.col("total")
    return total.join(tiers(spark), "pair_kind").join(shown, ["mode_a", "mode_b"], "left").select(
        "mode_a", "mode_b", "total", "matching", "missing", F.round(rate, 8).alias("match_rate"),
        F.col("match_rate_limit").alias("threshold"), ((rate >= F.col("match_rate_limit")) & (F.col("missing") == 0)).alias("passed"),
        F.coalesce("first_mismatches", F.lit("")).alias("first_mismatches"))


@query(
    "compare_probabilities",
    f"""with {RUNS_SQL}, c as (select mode_a, mode_b, pair_kind, a.vec_id, a.p as p, b.p as q, greatest(a.p, 1e-10) as pc, greatest(b.p, 1e-10) as qc
          from pairs join probs a on a.mode = mode_a join probs b on b.mode = mode_b and b.vec_id = a.vec_id and b.k = a.k),
        r as (select mode_a, mode_b, pair_kind, vec_id, max(abs(p - q)) as max_abs, avg(abs(p - q)) as mean_abs, max(abs(p - q) / greatest(abs(p), 1e-10)) as max_rel,
          avg(abs(p - q) / greatest(abs(p), 1e-10)) as mean_rel, sum(pc * ln(pc / qc)) as kl_pq, sum(qc * ln(qc / pc)) as kl_qp,
          sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)) + 1e-10) as cosine,
          bool_and(abs(p - q) <= atol + rtol * abs(q)) as close from c join tiers using (pair_kind) group by all)
      select mode_a, mode_b, round(max(max_abs), 8) as max_abs_diff, round(avg(mean_abs), 9) as mean_abs_diff, round(max(max_rel), 7) as max_rel_diff,
        round(avg(mean_rel), 8) as mean_rel_diff, round((avg(kl_pq) + avg(kl_qp)) / 2, 9) as sym_kl, round(avg(cosine), 9) as mean_cosine,
        bool_and(close) as all_close, bool_and(close) or ((avg(kl_pq) + avg(kl_qp)) / 2 < 0.01 and avg(cosine) > 0.999) as passed
      from r group by all""",
)
def compare_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Distances between the class distributions of two modes, row by row and overall."""
    probs = mode_scores(spark, d).select("mode", "vec_id", softmax().alias("p"))
    eps = 1e-10
    both = pairs_of(probs, ["vec_id"], ["p"]).join(tiers(spark), "pair_kind")
    fold = lambda f: F.aggregate(F.zip_with("p_a", "p_b", f), F.lit(0.0), lambda s, v: s + v)
    clip = lambda v: F.greatest(v, F.lit(eps))
    diff = F.zip_with("p_a", "p_b", lambda p, q: F.abs(p - q))
    rel = F.zip_with("p_a", "p_b", lambda p, q: F.abs(p - q) / F.greatest(F.abs(p), F.lit(eps)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    rows = both.select(
        "mode_a", "mode_b", F.array_max(diff).alias("max_abs"), mean(diff).alias("mean_abs"), F.array_max(rel).alias("max_rel"),
        mean(rel).alias("mean_rel"), fold(lambda p, q: clip(p) * F.log(clip(p) / clip(q))).alias("kl_pq"),
        fold(lambda p, q: clip(q) * F.log(clip(q) / clip(p))).alias("kl_qp"),
        (fold(lambda p, q: p * q) / (F.sqrt(fold(lambda p, q: p * p)) * F.sqrt(fold(lambda p, q: q * q)) + eps)).alias("cosine"),
        F.forall(F.zip_with("p_a", "p_b", lambda p, q: F.abs(p - q) <= F.col("atol") + F.col("rtol") * F.abs(q)), lambda ok: ok).alias("close"))
    agg = rows.groupBy("mode_a", "mode_b").agg(
        F.max("max_abs").alias("max_abs"), F.avg("mean_abs").alias("mean_abs"), F.max("max_rel").alias("max_rel"),
        F.avg("mean_rel").alias("mean_rel"), ((F.avg("kl_pq") + F.avg("kl_qp")) / 2).alias("kl"), F.avg("cosine").alias("cosine"),
        F.bool_and("close").alias("all_close"))
    return agg.select(
        "mode_a", "mode_b", F.round("max_abs", 8).alias("max_abs_diff"), F.round("mean_abs", 9).alias("mean_abs_diff"),
        F.round("max_rel", 7).alias("max_rel_diff"), F.round("mean_rel", 8).alias("mean_rel_diff"), F.round("kl", 9).alias("sym_kl"),
        F.round("cosine", 9).alias("mean_cosine"), "all_close",
        (F.col("all_close") | ((F.col("kl") < 0.01) & (F.col("cosine") > 0.999))).alias("passed"))


def epoch_losses(spark: SparkSession, d: str) -> DataFrame:
    """``mode, data_type, epoch, loss, accuracy``: at epoch e the logits are e times as sharp."""
    curves = mode_scores(spark, d).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    sharp = curves.withColumn("logits", F.transform("logits", lambda v: v * F.col("epoch")))
    return evaluate(sharp, "mode", "data_type", "epoch").drop("n_rows")


_LOSS_SQL = f""", curve as (select mode, data_type, vec_id, label, k, epoch, logit * epoch as logit from probs, generate_series(1, {EPOCHS}) g(epoch)),
  losses as (select mode, data_type, epoch, avg(-ln(p)) filter (k = label) as loss from (
    select *, exp(logit - m) / sum(exp(logit - m)) over (partition by mode, vec_id, epoch) as p from (
      select *, max(logit) over (partition by mode, vec_id, epoch) as m from curve)) group by all),
  lcmp as (select mode_a, mode_b, pair_kind, a.data_type, max(abs(a.loss - b.loss)) as max_diff, avg(abs(a.loss - b.loss)) as mean_diff,
    arg_min(a.loss, a.epoch) > arg_max(a.loss, a.epoch) as a_conv, arg_min(b.loss, b.epoch) > arg_max(b.loss, b.epoch) as b_conv,
    abs(arg_max(a.loss, a.epoch) - arg_max(b.loss, b.epoch)) as final_diff
    from pairs join losses a on a.mode = mode_a join losses b on b.mode = mode_b and b.data_type = a.data_type and b.epoch = a.epoch group by all)"""


def _loss_pairs(spark: SparkSession, d: str) -> DataFrame:
    both = pairs_of(epoch_losses(spark, d), ["data_type", "epoch"], ["loss"])
    first = lambda c: F.min_by(c, "epoch")
    last = lambda c: F.max_by(c, "epoch")
    diff = F.abs(F.col("loss_a") - F.col("loss_b"))
    return both.groupBy("mode_a", "mode_b", "pair_kind", "data_type").agg(
        F.max(diff).alias("max_diff"), F.avg(diff).alias("mean_diff"), (last("loss_a") < first("loss_a")).alias("a_conv"),
        (last("loss_b") < first("loss_b")).alias("b_conv"), F.abs(last("loss_a") - last("loss_b")).alias("final_diff"))


@query(
    "compare_losses",
    f"""with {RUNS_SQL}{_LOSS_SQL} select mode_a, mode_b, data_type, round(max_diff, 8) as max_epoch_diff, round(mean_diff, 8) as mean_epoch_diff,
      a_conv as a_converging, b_conv as b_converging, round(final_diff, 8) as final_loss_diff, loss_limit as threshold,
      a_conv and b_conv and final_diff < loss_limit as passed from lcmp join tiers using (pair_kind)""",
)
def compare_losses(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("a_conv") & F.col("b_conv") & (F.col("final_diff") < F.col("loss_limit"))
    return _loss_pairs(spark, d).join(tiers(spark), "pair_kind").select(
        "mode_a", "mode_b", "data_type", F.round("max_diff", 8).alias("max_epoch_diff"), F.round("mean_diff", 8).alias("mean_epoch_diff"),
        F.col("a_conv").alias("a_converging"), F.col("b_conv").alias("b_converging"), F.round("final_diff", 8).alias("final_loss_diff"),
        F.col("loss_limit").alias("threshold"), ok.alias("passed"))


def mode_hashes(spark: SparkSession, d: str) -> DataFrame:
    """``mode, model_hash``: one tree hash over the weights each mode keeps, six decimals."""
    params = parameters(spark, d)
    all_modes = reduce(DataFrame.unionByName, [
        params.withColumns({"value": F.round("value", n), "mode": F.lit(m)}) for m, n in MODES.items()])
    text = F.round(F.col("value") * 1_000_000).cast("bigint").cast("string")
    per_name = hash_tree(all_modes, "idx", text, ["mode", "label"])
    return hash_tree(per_name, "label", F.col("fingerprint"), ["mode"]).withColumnRenamed("fingerprint", "model_hash")


_HASH_SQL = (
    ", " + hash_tree_sql("hname", "wts", "j", "(round(w * 1000000)::bigint)::varchar", "mode, k") + ", " + hash_tree_sql("htree", "hname", "k", "h", "mode")
    + ", hashes as (select mode, h as model_hash from htree)")

_NOTES = {
    "self": "one mode twice: equal hashes are required", "same_device": "sums may run in another order: equal hashes are not required",
    "cross_device": "other arithmetic: equal hashes are not required"}
_NOTE_SQL = "case pair_kind " + " ".join(f"when '{k}' then '{v}'" for k, v in _NOTES.items()) + " end"


def _note() -> Column:
    return F.coalesce(*[F.when(F.col("pair_kind") == k, v) for k, v in _NOTES.items()])


@query(
    "compare_hashes",
    f"""with {RUNS_SQL}{_HASH_SQL} select mode_a, mode_b, left(a.model_hash, 16) as hash_a, left(b.model_hash, 16) as hash_b,
      a.model_hash = b.model_hash as match, pair_kind <> 'self' or a.model_hash = b.model_hash as passed, {_NOTE_SQL} as note
      from pairs join hashes a on a.mode = mode_a join hashes b on b.mode = mode_b""",
)
def compare_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Model hashes of two modes; only the same mode must agree with itself."""
    hashes = mode_hashes(spark, d).withColumn("k", F.lit(1))
    both = pairs_of(hashes, ["k"], ["model_hash"])
    match = F.equal_null("model_hash_a", "model_hash_b")
    return both.select("mode_a", "mode_b", F.left("model_hash_a", F.lit(16)).alias("hash_a"), F.left("model_hash_b", F.lit(16)).alias("hash_b"),
                       match.alias("match"), ((F.col("pair_kind") != "self") | match).alias("passed"), _note().alias("note"))


_ACC_SQL = """, accs as (select mode, data_type, avg((prediction = label)::int) as acc from preds group by all),
  acmp as (select mode_a, mode_b, pair_kind, a.data_type, a.acc as acc_a, b.acc as acc_b, abs(a.acc - b.acc) as diff
    from pairs join accs a on a.mode = mode_a join accs b on b.mode = mode_b and b.data_type = a.data_type)"""


def _accuracy_pairs(spark: SparkSession, d: str) -> DataFrame:
    acc = mode_scores(spark, d).groupBy("mode", "data_type").agg(F.avg((top1() == F.col("label")).cast("double")).alias("acc"))
    return pairs_of(acc, ["data_type"], ["acc"]).withColumn("diff", F.abs(F.col("acc_a") - F.col("acc_b")))


@query(
    "compare_accuracy",
    f"""with {RUNS_SQL}{_ACC_SQL} select mode_a, mode_b, data_type, round(acc_a, 8) as accuracy_a, round(acc_b, 8) as accuracy_b,
      round(diff, 8) as difference, accuracy_limit as threshold, diff <= accuracy_limit as passed from acmp join tiers using (pair_kind)""",
)
def compare_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _accuracy_pairs(spark, d).join(tiers(spark), "pair_kind").select(
        "mode_a", "mode_b", "data_type", F.round("acc_a", 8).alias("accuracy_a"), F.round("acc_b", 8).alias("accuracy_b"),
        F.round("diff", 8).alias("difference"), F.col("accuracy_limit").alias("threshold"),
        (F.col("diff") <= F.col("accuracy_limit")).alias("passed"))


_RUN_CHECK_SQL = f"""{_LOSS_SQL}{_HASH_SQL}{_ACC_SQL}, checks as (
  select l.mode_a, l.mode_b, l.data_type, l.pair_kind, l.pair_kind <> 'self' or ha.model_hash = hb.model_hash as hash_ok, ha.model_hash = hb.model_hash as hash_match,
    a_conv and b_conv and final_diff < loss_limit as loss_ok, diff <= accuracy_limit as acc_ok
  from lcmp l join acmp a using (mode_a, mode_b, data_type) join tiers t on t.pair_kind = l.pair_kind
    join hashes ha on ha.mode = l.mode_a join hashes hb on hb.mode = l.mode_b)"""


def run_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair of modes and kind of data with the outcome of each check."""
    key = ["mode_a", "mode_b", "pair_kind"]
    hashes = pairs_of(mode_hashes(spark, d).withColumn("k", F.lit(1)), ["k"], ["model_hash"]).select(
        *key, F.equal_null("model_hash_a", "model_hash_b").alias("hash_match"))
    return (
        _loss_pairs(spark, d).join(_accuracy_pairs(spark, d), [*key, "data_type"]).join(hashes, key).join(tiers(spark), "pair_kind")
        .select(*key, "data_type", "hash_match", ((F.col("pair_kind") != "self") | F.col("hash_match")).alias("hash_ok"),
                (F.col("a_conv") & F.col("b_conv") & (F.col("final_diff") < F.col("loss_limit"))).alias("loss_ok"),
                (F.col("diff") <= F.col("accuracy_limit")).alias("acc_ok")))


@query(
    "compare_runs",
    f"""with {RUNS_SQL}{_RUN_CHECK_SQL} select mode_a, mode_b, data_type, hash_ok and loss_ok and acc_ok as passed,
      concat_ws(',', case when not hash_ok then 'model_hash' end, case when not loss_ok then 'losses' end, case when not acc_ok then 'accuracy' end) as failures,
      case when not hash_match then 'model hashes differ' else '' end as warnings from checks""",
)
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """All checks of a pair: it passes when none fails; hash differences are only a warning."""
    named = {"model_hash": "hash_ok", "losses": "loss_ok", "accuracy": "acc_ok"}
    failures = F.array_compact(F.array(*[F.when(~F.col(c), n) for n, c in named.items()]))
    return run_checks(spark, d).select(
        "mode_a", "mode_b", "data_type", (F.size(failures) == 0).alias("passed"), F.array_join(failures, ",").alias("failures"),
        F.when(~F.col("hash_match"), "model hashes differ").otherwise("").alias("warnings"))


@query(
    "repro_report",
    f"""with {RUNS_SQL}{_RUN_CHECK_SQL} select coalesce(data_type, 'all') as data_type, coalesce(pair_kind, 'all') as pair_kind, count(*) as total,
      count_if(hash_ok and loss_ok and acc_ok) as passed, count_if(not (hash_ok and loss_ok and acc_ok)) as failed,
      bool_and(hash_ok and loss_ok and acc_ok) as overall_passed from checks group by rollup (data_type, pair_kind)""",
)
def repro_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all pairs, by kind of data and kind of pair."""
    ok = F.col("hash_ok") & F.col("loss_ok") & F.col("acc_ok")
    report = run_checks(spark, d).rollup("data_type", "pair_kind").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.bool_and(ok).alias("overall_passed"))
    return report.select(F.coalesce("data_type", F.lit("all")).alias("data_type"), F.coalesce("pair_kind", F.lit("all")).alias("pair_kind"),
                         "total", "passed", "failed", "overall_passed")


@query(
    "hash_agreement",
    f"with {RUNS_SQL}, " + hash_tree_sql("ph", "preds", "vec_id", "vec_id || ':' || prediction", "mode, data_type") + """
      select coalesce(data_type, 'all') as data_type, coalesce(split_part(mode, '_', 2), 'any') as device, count(distinct h) as n_hashes, count(distinct h) <= 1 as all_match
      from ph group by grouping sets ((data_type, split_part(mode, '_', 2)), (data_type))""",
)
def hash_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Do all modes give the same predictions, overall and per device family?"""
    preds = mode_scores(spark, d).select("mode", "data_type", "vec_id", top1().alias("prediction"))
    text = F.concat_ws(":", F.col("vec_id").cast("string"), F.col("prediction").cast("string"))
    hashes = hash_tree(preds, "vec_id", text, ["mode", "data_type"]).withColumn("device", F.substring_index("mode", "_", -1))
    by = hashes.groupingSets([["data_type", "device"], ["data_type"]], "data_type", "device").agg(
        F.count_distinct("fingerprint").alias("n_hashes"))
    return by.select("data_type", F.coalesce("device", F.lit("any")).alias("device"), "n_hashes", (F.col("n_hashes") <= 1).alias("all_match"))
