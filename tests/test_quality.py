"""Jobs without an SQL twin, against brute force, bounds or quality floors."""

from __future__ import annotations

import datetime
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspan.functions.scalar_packs import identities
from larkspan.operators.project import sample_counts
from larkspan.operators.sorting import layout_parts
from larkspan.plans.features import projections
from larkspan.plans.learning import cluster_quality
from larkspan.plans.metrics import approx_percentiles
from larkspan.plans.training import als_steps, kmeans_steps, logistic_history, softmax_history
from larkspan.streaming.sinks import stream_progress

Q = entry.queries()


def run(spark, sf_dir, key):
    return Q[key](spark, sf_dir)


def test_sketches_near_exact(spark, sf_dir):
    from larkspan.operators.aggregates import sketches

    for r in sketches(spark, sf_dir).collect():
        assert r["orders_bitmap"] == r["orders_exact"]
        assert abs(r["orders_approx"] / r["orders_exact"] - 1) < 0.08
        assert abs(r["orders_hll"] / r["orders_exact"] - 1) < 0.05
        assert r["hist_bins"] == 5 and r["cms_bytes"] > 0


def test_sketch_union_holds_keys_of_many_buckets(spark):
    from larkspan.operators.aggregates import union_of_sketches

    keys = [1, 5, 32_767, 32_768, 32_769, 70_000, 2_000_000, 3_000_000_000]
    rows = [(datetime.date(2020 + i % 2, 1 + i % 5, 1), keys[i % len(keys)]) for i in range(64)]
    got = {r["y"]: r["bits"] for r in union_of_sketches(spark.createDataFrame(rows, "day date, k bigint"), "day", "k").collect()}
    assert got == {y: len({k for d, k in rows if d.year == y}) for y in (2020, 2021)}


def test_fn_sketch(spark, sf_dir, duck):
    from larkspan.functions.aggregate_pack import sketch_functions

    want = dict(duck.execute("select l_linenumber, count(distinct l_partkey) from lineitem group by 1").fetchall())
    for r in sketch_functions(spark, sf_dir).collect():
        assert abs(r["hll_sketch_estimate_"] / want[r["l_linenumber"]] - 1) < 0.1
        assert r["hll_union_"] > 0 and r["histogram_bins"] == 4 and r["sketch_bytes"] > 0


def test_frequent_values(spark, sf_dir):
    from larkspan.operators.aggregates import frequent_items

    r = frequent_items(spark, sf_dir).first()
    assert r["flags"] == "A,N,R" and r["statuses"] == "F,O" and r["q25"] <= r["q50"] <= r["q75"]


def test_checksums(spark, sf_dir, duck):
    text = dict(duck.execute("select doc_id, text from documents").fetchall())
    for r in run(spark, sf_dir, "fn_hash_values").collect():
        assert r["crc32_"] == zlib.crc32(text[r["doc_id"]].encode())


def test_samples(spark, sf_dir, duck):
    kinds = dict(duck.execute("select event_type, count(*) from events group by 1").fetchall())
    kept = {r["event_type"]: r["count"] for r in run(spark, sf_dir, "stratified_sample").groupBy("event_type").count().collect()}
    for kind, share in {"purchase": 0.5, "signup": 0.25, "error": 0.1}.items():
        n = kinds[kind]
        assert abs(kept[kind] - n * share) < 5 * math.sqrt(n * share * (1 - share)) + 1
    split = {(r["kind"], r["event_type"]): r["n"] for r in sample_counts(spark, sf_dir).collect()}
    for kind, n in kinds.items():
        assert split[("split_70", kind)] + split[("split_30", kind)] == n


def test_layouts(spark, sf_dir, duck):
    rows = layout_parts(spark, sf_dir).collect()
    total = duck.execute("select count(*) from lineitem").fetchone()[0]
    for layout in ("range", "coalesced"):
        assert sum(r["n"] for r in rows if r["layout"] == layout) == total
    ranged = sorted((r["low"], r["high"]) for r in rows if r["layout"] == "range")
    assert all(a[1] <= b[0] for a, b in zip(ranged, ranged[1:]))
    assert run(spark, sf_dir, "sort_partitions").count() == total


def test_identity(spark, sf_dir):
    rows = identities(spark, sf_dir).collect()
    assert {r["file"] for r in rows} == {"supplier.parquet"} and len({r["row_id"] for r in rows}) == len(rows)


def test_latency_approx(spark, sf_dir):
    exact = {r["event_type"]: r for r in run(spark, sf_dir, "latency_percentiles").collect()}
    for r in approx_percentiles(spark, sf_dir).collect():
        assert abs(r["p50"] - exact[r["event_type"]]["p50"]) < 5


@pytest.mark.parametrize("key", ["gen_tabular", "gen_inputs", "gen_graph", "score_generated"])
def test_generation_does_not_depend_on_partitions(spark, sf_dir, key):
    got = []
    for n in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20) if n == 1 else str(1 << 14))
        got.append(sorted(map(repr, run(spark, sf_dir, key).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1]


def test_gen_tabular(spark, sf_dir):
    pdf = run(spark, sf_dir, "gen_tabular").toPandas()
    x = np.stack(pdf["features"].to_numpy())
    assert x.shape[1] == 20 and set(pdf["label"]) == set(range(5))
    flipped = (pdf["label"] != pdf["true_class"]).mean()
    assert 0.03 < flipped < 0.07
    centres = np.stack([x[pdf["true_class"] == c, :10].mean(axis=0) for c in range(5)])
    near = ((x[:, None, :10] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (near == pdf["true_class"]).mean() > 0.9
    assert np.allclose(x[:, 10], 0.6 * x[:, 0] + 0.4 * x[:, 3], atol=1e-5)


def test_gen_images(spark, sf_dir):
    pdf = run(spark, sf_dir, "gen_images").toPandas()
    x = np.stack(pdf["pixels"].to_numpy())
    assert x.shape[1] == 784 and x.min() == 0 and x.max() == 1 and x.std() > 0.1


def test_gen_inputs(spark, sf_dir):
    pdf = run(spark, sf_dir, "gen_inputs").toPandas()
    t = np.stack(pdf["token_ids"].to_numpy())
    assert t.shape[1] == 128 and t.min() >= 0 and t.max() < 30_522
    f = np.stack(pdf["features"].to_numpy())
    assert abs(f.mean()) < 0.1 and abs(f.std() - 1) < 0.1


def test_gen_graph(spark, sf_dir):
    rows = run(spark, sf_dir, "gen_graph").groupBy("src").count().toPandas()["count"]
    assert rows.min() >= 1 and 2 < rows.mean() < 7 and rows.max() > 8


def test_random_columns(spark, sf_dir):
    r = {x["name"]: x for x in run(spark, sf_dir, "random_columns").collect()}
    assert abs(r["uniform"]["mean"] - 0.5) < 0.05 and abs(r["normal"]["sd"] - 1) < 0.1 and abs(r["exponential"]["mean"] - 1) < 0.15


def test_pi(spark, sf_dir):
    assert abs(run(spark, sf_dir, "mc_pi").first()["pi"] - math.pi) < 0.08


@pytest.mark.parametrize("history, floor", [(softmax_history, 0.8), (logistic_history, 0.7)])
def test_loss_falls(spark, sf_dir, history, floor):
    rows = history(spark, sf_dir).orderBy("epoch").collect()
    assert len(rows) == 4 and rows[-1]["loss"] < 0.8 * rows[0]["loss"]
    assert rows[-1]["test_accuracy"] >= floor and rows[-1]["n_test"] + rows[-1]["n_train"] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_gradient_matches_numbers(spark):
    from larkspan.plans.training import softmax_gradient, summed_gradient

    rng = np.random.default_rng(1)
    x, y, theta = rng.normal(size=(40, 3)), rng.integers(0, 3, 40), rng.normal(size=12) * 0.1
    f = softmax_gradient(3)
    g, loss, _ = f(theta, x, y)
    for i in range(12):
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert abs((f(up, x, y)[1] - f(down, x, y)[1]) / 2e-6 - g[i]) < 1e-3
    data = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y)], "x array<double>, y int").repartition(5)
    summed, total, _, n = summed_gradient(data, theta, f)
    assert n == 40 and np.allclose(summed, g) and abs(total - loss) < 1e-9


def test_kmeans_cost_falls(spark, sf_dir):
    cost = [r["cost"] for r in kmeans_steps(spark, sf_dir).orderBy("step").collect()]
    assert all(b <= a + 1e-9 for a, b in zip(cost, cost[1:]))


def test_als_fits(spark, sf_dir):
    rows = als_steps(spark, sf_dir).orderBy("step").collect()
    assert rows[-1]["rmse"] <= rows[0]["rmse"] < 1.5
    top = run(spark, sf_dir, "als_topk").toPandas()
    assert (top.groupby("user")["score"].apply(lambda s: s.is_monotonic_decreasing)).all()


@pytest.mark.parametrize("bound", [None, 150])
def test_chunk_metrics(spark, sf_dir, duck, bound):
    """In one block of weights and in several."""
    from larkspan.plans.scoring import chunk_runs, parameters, samples, weight_blocks

    params = parameters(spark, sf_dir)
    assert (len(list(weight_blocks(params, bound))) > 1) == (bound is not None)
    rows = chunk_runs(samples(spark, sf_dir), params, bound).collect()
    assert sum(r["samples"] for r in rows) == duck.execute("select count(*) from embeddings").fetchone()[0]
    assert all(r["throughput"] > 0 and r["hosts"] == 1 and r["device"] == "cpu" and r["memory_mb"] > 10 for r in rows)
    whole = {r["chunk"]: r["hits"] for r in run(spark, sf_dir, "chunk_metrics").collect()}
    assert {r["chunk"]: r["hits"] for r in rows} == whole


def test_rank_by_tolerance_is_a_fixed_point(spark, sf_dir):
    from larkspan.plans.graph import both_ways, rank_steps, trade_edges

    ranks = {r["id"]: r["rank"] for r in rank_steps(both_ways(trade_edges(spark, sf_dir).select("src", "dst")), tolerance=1e-4).collect()}
    edges = [(r["src"], r["dst"]) for r in both_ways(trade_edges(spark, sf_dir).select("src", "dst")).collect()]
    degree, got = {}, {}
    for a, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    for a, b in edges:
        got[b] = got.get(b, 0.0) + ranks[a] / degree[a]
    assert max(abs(ranks[i] - (0.15 + 0.85 * got.get(i, 0.0))) for i in ranks) < 2e-4


@pytest.mark.parametrize("key", ["logreg", "classifiers", "tree_classifiers", "regressors", "tree_regressors", "tune"])
def test_models_reach_their_floors(spark, sf_dir, key):
    from larkspan.plans import learning

    rows = getattr(learning, f"{key}_quality")(spark, sf_dir).collect()
    assert rows and all((r["model"], r["metric"]) in learning.FLOORS for r in rows)
    held = {(r["model"], r["metric"]): r["reached"] for r in learning._held(spark.createDataFrame(rows)).collect()}
    assert all(held.values()), [(r["model"], r["metric"], r["value"]) for r in rows if not held[r["model"], r["metric"]]]


def test_clusters(spark, sf_dir):
    got = {r["model"]: r["value"] for r in cluster_quality(spark, sf_dir).collect()}
    assert got["kmeans"] > 0 and got["power_iteration"] == 2.0 and set(got) == {"kmeans", "bisecting", "gaussian", "lda", "power_iteration"}


def test_sequential_patterns(spark, sf_dir, duck):
    got = {r["pattern"]: r["freq"] for r in run(spark, sf_dir, "sequential_patterns").collect()}
    first = duck.execute("select user_id, event_type, min(ts) as t from events group by all order by t").fetchall()
    order = {}
    for u, e, _ in first:
        order.setdefault(u, []).append(e)
    for pattern, freq in got.items():
        steps = pattern.split(">")
        hits = 0
        for seq in order.values():
            it = iter(seq)
            hits += all(s in it for s in steps)
        assert hits == freq, pattern


def test_lsh_documents(spark, sf_dir, duck):
    import re

    words = lambda t: set(re.split(r"[ \n\t]+", t))
    docs = {i: words(t) for i, t in duck.execute("select doc_id, text from documents").fetchall()}
    items = {i: words(t) for i, t in duck.execute("select item_id, text from benchmark").fetchall()}
    found = {(r["item_id"], r["doc_id"]): r["distance"] for r in run(spark, sf_dir, "lsh_documents").collect()}
    exact = {(i, j): 1 - len(a & b) / len(a | b) for i, a in items.items() for j, b in docs.items()}
    for pair, dist in found.items():
        assert abs(exact[pair] - dist) < 0.02
    close = {p for p, x in exact.items() if x < 0.5}
    assert len(close & set(found)) >= 0.9 * len(close)


def test_lsh_embeddings(spark, sf_dir, duck):
    rows = duck.execute("select vec_id, label, embedding from embeddings").fetchall()
    x = {i: np.array(e, dtype=float) for i, _, e in rows}
    labels = {i: y for i, y, _ in rows}
    means = {y: np.mean([x[i] for i in x if labels[i] == y], axis=0) for y in set(labels.values())}
    found = run(spark, sf_dir, "lsh_embeddings").collect()
    assert found
    for r in found:
        assert abs(np.linalg.norm(x[r["vec_id"]] - means[int(r["label"])]) - r["distance"]) < 1e-6


def test_singular_values(spark, sf_dir, duck):
    x = np.array([r[0] for r in duck.execute("select embedding from embeddings").fetchall()], dtype=float)
    got = [r["singular_value"] for r in run(spark, sf_dir, "gram_svd").orderBy("component").collect()]
    assert np.allclose(got, np.linalg.svd(x, compute_uv=False), atol=1e-6)


def test_projection(spark, sf_dir):
    rows = projections(spark, sf_dir).collect()
    assert all(len(r["poly"]) == 64 * 67 // 2 and len(r["pca"]) == 3 and len(r["dct"]) == 64 for r in rows)
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()], float)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = np.array([r["pca"] for r in sorted(rows, key=lambda r: r["vec_id"])])
    assert np.allclose(np.abs(got), np.abs(x @ vt[:3].T), atol=1e-6)


def test_statistical_tests(spark, sf_dir, duck):
    got = {(r["test"], r["measure"]): r["value"] for r in run(spark, sf_dir, "stat_tests").collect()}
    r, mean, n = duck.execute("select corr(l_quantity, l_discount), avg(l_quantity), count(*) from lineitem").fetchone()
    assert abs(got[("pearson", "quantity_discount")] - r) < 1e-6 and abs(got[("summary", "mean_quantity")] - mean) < 1e-4
    cells = duck.execute("select l_returnflag, l_linestatus, count(*) from lineitem group by all").fetchall()
    a, b = {}, {}
    for f, s, c in cells:
        a[f], b[s] = a.get(f, 0) + c, b.get(s, 0) + c
    chi = sum((c - a[f] * b[s] / n) ** 2 / (a[f] * b[s] / n) for f, s, c in cells)
    assert abs(got[("chi_square", "statistic")] - chi) < 1e-3


def test_normality(spark, sf_dir):
    got = {r["sample"]: r["p_value"] for r in run(spark, sf_dir, "ks_hypothesis").collect()}
    assert got["seeded_normal"] > 0.001 and got["scaled_balance"] < 0.001


def test_evaluators(spark, sf_dir, duck):
    got = {(r["model"], r["metric"]): r["value"] for r in run(spark, sf_dir, "eval_metrics").collect()}
    rmse = duck.execute("select sqrt(avg(pow(l_quantity - l_extendedprice / 1000, 2))) from lineitem").fetchone()[0]
    assert abs(got[("regression", "rmse")] - rmse) < 1e-5
    auc = entry.queries()["metrics_binary"](spark, sf_dir).first()["auc"]
    assert abs(got[("binary", "auc")] - auc) < 0.02
    assert abs(got[("multilabel", "accuracy")] - entry.queries()["metrics_multilabel"](spark, sf_dir).first()["jaccard"]) < 0.2


def test_other_features(spark, sf_dir):
    assert run(spark, sf_dir, "word2vec").count() > 10
    bins = run(spark, sf_dir, "quantile_bins").collect()
    assert len(bins) == 4 and max(b["n"] for b in bins) < 1.5 * min(b["n"] for b in bins)
    robust = run(spark, sf_dir, "scale_robust").toPandas()["robust_bal"]
    assert abs(robust.median()) < 0.05 and abs(robust.quantile(0.75) - robust.quantile(0.25) - 1) < 0.05
    kept = run(spark, sf_dir, "select_features").toPandas()
    assert (kept[kept["selector"] != "variance"].groupby("selector").size() == 10).all()
    model = run(spark, sf_dir, "formula_model").toPandas()
    assert (model["label"] == model["prediction"]).mean() > 0.9


def test_stream_progress(spark, sf_dir, duck):
    rows, last = stream_progress(spark, sf_dir)
    n = duck.execute("select count(*) from events").fetchone()[0]
    for origin in ("query", "listener"):
        own = [r for r in rows.collect() if r["origin"] == origin]
        assert sum(r["input_rows"] for r in own) == n and max(r["batch_id"] for r in own) == last


@pytest.mark.parametrize("key", ["stream_logreg", "stream_kmeans"])
def test_stream_models(spark, sf_dir, duck, key):
    rows = run(spark, sf_dir, key).orderBy("batch").collect()
    table = {"stream_logreg": "orders", "stream_kmeans": "embeddings"}[key]
    assert sum(r["n_rows"] for r in rows) == duck.execute(f"select count(*) from {table}").fetchone()[0]
    if key == "stream_logreg":
        assert rows[-1]["loss"] < rows[0]["loss"] or rows[-1]["accuracy"] > 0.7


def test_score_by_join_equals_broadcast(spark, sf_dir, monkeypatch):
    from larkspan.plans import scoring

    small = sorted(map(tuple, run(spark, sf_dir, "score_broadcast").collect()))
    monkeypatch.setattr(scoring, "MAX_BROADCAST_PARAMETERS", 1)
    assert sorted(map(tuple, run(spark, sf_dir, "score_broadcast").collect())) == small
    for key in ("compare_predictions", "hybrid_route", "score_mlp", "score_predict_batch"):
        con = duckdb.connect()
        for t in ("embeddings",):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        from tests.oracle import compare

        verdict, detail, _ = compare(spark, sf_dir, Q[key], entry.oracle_sql()[key], con)
        assert verdict in ("ok", "NEAR"), (key, detail)


def test_long_chains_settle(spark):
    """A chain of 150 steps: closure by doubling, components, and a hash tree over ids beyond a million."""
    from larkspan.plans.graph import closure, components
    from larkspan.plans.scoring import hash_tree

    chain = spark.range(150).select(F.col("id").cast("string").alias("child"), (F.col("id") + 1).cast("string").alias("ancestor"))
    assert closure(chain).count() == 151 * 150 // 2
    parts = components(spark.range(150).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))).collect()
    assert {r["component"] for r in parts} == {0} and len(parts) == 151
    ids = spark.createDataFrame([(i, str(i)) for i in (-5, 3, 4096, 1_000_001, 2**40, 2**62)], "id bigint, t string")
    one = hash_tree(ids, "id", F.col("t")).collect()
    assert len(one) == 1 and one != hash_tree(ids.filter("id < 1000"), "id", F.col("t")).collect()
