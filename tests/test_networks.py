"""Learned layers and barrier training: gradients by finite differences, the same parameters as a step-by-step training, held-out accuracy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.plans import networks, training
from larkspan.plans.networks import Network
from larkspan.plans.optimizer import Adam


@pytest.mark.parametrize("network", [Network(3, (), 2), Network(4, (5,), 3), Network(4, (6, 5), 3), Network(4, (5,), 3, attention=True), Network(3, (), 2, attention=True)])
def test_gradient_of_every_layer(network):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(11, network.n_features)), rng.integers(0, network.n_classes, 11)
    theta = network.start() + rng.normal(0, 0.1, network.size)
    grad, loss, hits = network.gradient(theta, x, y)
    assert hits == (network.logits(theta, x).argmax(1) == y).sum() and loss > 0
    for i in range(network.size):
        step = np.zeros(network.size)
        step[i] = 1e-6
        slope = (network.gradient(theta + step, x, y)[1] - network.gradient(theta - step, x, y)[1]) / 2e-6
        assert abs(slope - grad[i]) < 1e-5 * max(1, abs(slope))


def samples(spark, n=300, width=4):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    data = [(i, [float(c) for c in v], int(label), "test" if i % 5 == 0 else "train") for i, (v, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id bigint, x array<double>, y int, part string"), x, y


@pytest.mark.parametrize("tasks", [1, 8])
def test_barrier_training_equals_one_step_at_a_time(spark, tasks):
    data, x, y = samples(spark)
    network = Network(4, (6,), 2)
    theta, history = networks.train_in_barrier(data, network.start(), network.gradient, 3, 0.05, 2, tasks)
    batch_of = {r["id"]: r["b"] for r in data.select("id", F.array(*[(training.hashed(F.lit(e), F.col("id")) % 2).cast("int") for e in (1, 2, 3)]).alias("b")).collect()}
    teaches = np.array([i % 5 != 0 for i in range(len(y))])
    want, adam = network.start(), Adam(network.size, 0.05)
    for epoch in range(3):
        met = np.zeros(3)
        for step in range(2):
            mine = teaches & np.array([batch_of[i][epoch] == step for i in range(len(y))])
            g, loss, hits = network.gradient(want, x[mine], y[mine])
            want = adam.step(want, g / mine.sum())
            met += [loss, hits, mine.sum()]
        assert history[epoch][:4] == (epoch + 1, pytest.approx(met[0] / met[2]), pytest.approx(met[1] / met[2]), teaches.sum())
    assert np.abs(theta - want).max() < 1e-9
    _, loss, hits = network.gradient(want, x[~teaches], y[~teaches])
    assert history[-1][4:] == (pytest.approx(loss / (~teaches).sum()), pytest.approx(hits / (~teaches).sum()), (~teaches).sum())


def test_barrier_training_equals_training_by_scans(spark):
    data, _, _ = samples(spark)
    gradient = training.softmax_gradient(2)
    theta, history = networks.train_in_barrier(data, np.zeros(10), gradient, training.EPOCHS, training.RATE, training.STEPS)
    want, by_scan = training.train(data.where("part = 'train'"), 10, gradient)
    assert np.abs(theta - want).max() < 1e-9
    assert [h[:4] for h in history] == [pytest.approx(h) for h in by_scan]


def test_training_without_rows(spark):
    data, _, _ = samples(spark)
    network = Network(4, (3,), 2)
    theta, history = networks.train_in_barrier(data.limit(0), network.start(), network.gradient, 2, 0.1, 2)
    assert history == [] and (theta == network.start()).all()
    theta, history = networks.train_in_barrier(data.where("part = 'train'"), network.start(), network.gradient, 2, 0.1, 2)
    assert [h[4:] for h in history] == [(None, None, 0)] * 2


def test_parameters_as_a_table(spark):
    network = Network(3, (4, 2), 3, attention=True)
    theta = np.random.default_rng(1).normal(size=network.size)
    params = network.as_table(spark, theta)
    assert (network.from_table(params.repartition(5)) == theta).all()
    assert [r["name"] for r in params.select("layer", "name").distinct().orderBy("layer").collect()] == ["attention", "hidden_1", "hidden_2", "classes"]
    with pytest.raises(ValueError):
        network.from_table(params.limit(3))


@pytest.mark.parametrize("network", [networks.TABULAR, networks.ATTENTIVE])
def test_learned_layers_beat_a_linear_model(spark, sf_dir, network):
    data = networks.folded_classes(spark, sf_dir)
    linear = Network(networks.WIDTH, (), 2)
    flat = networks.trained(spark, data, linear)[1].orderBy("epoch").collect()[-1]
    params, history = networks.trained(spark, data, network)
    last = history.orderBy("epoch").collect()[-1]
    assert last["test_accuracy"] > max(0.85, flat["test_accuracy"] + 0.05) and last["n_test"] > 0, (last, flat)
    scored = networks.score(data, network, params).where("part = 'test'")
    assert scored.where("prediction = y").count() / scored.count() == pytest.approx(last["test_accuracy"])
    unlearned = networks.score(data, network, network.as_table(spark, network.start())).where("part = 'test' and prediction = y").count()
    assert unlearned / last["n_test"] < 0.8


def test_rows_of_a_task_are_held_in_parts(spark, monkeypatch):
    """However many rows a task has, a gradient sees a part of them at a time, and the parameters are those of the whole."""
    data, x, y = samples(spark)
    network = Network(4, (6,), 2)
    whole, told = networks.train_in_barrier(data, network.start(), network.gradient, 3, 0.05, 1, 1)
    most = 40


    monkeypatch.setattr(networks, "PART_ROWS", most)
    kept = networks._Held(iter([data.limit(100).selectExpr("x", "y", "part = 'train' as teaches", "array(1) as batch_of").toPandas()]), 1)
    assert [len(p) for p in kept.parts()] == [40, 40, 20] == [len(p) for p in kept.parts()]
    assert not list(networks._Held(iter([]), 1).parts())
    theta, history = networks.train_in_barrier(data, network.start(), network.gradient, 3, 0.05, 1, 1)
    assert np.abs(theta - whole).max() < 1e-9 and history[-1][3] == told[-1][3]
