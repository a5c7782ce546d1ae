"""Networks with learned hidden layers, and training inside one barrier stage.

A network is a stack of layers: an optional attention over the features, rectified hidden layers, and a softmax. Its gradient comes from
a reverse pass in numpy over an Arrow batch; Spark adds the gradients up. Its parameters are a table ``(layer, name, row, col, value)``.

``train_in_barrier`` runs all steps of all epochs as one job. Tasks of a barrier stage run at the same time; each keeps its rows, and
after every step they exchange their gradient sums by ``allGather``. Every task adds the sums up in the same order and takes the same
optimizer step, so all hold the same parameters and nothing goes through the driver until the end. A lost executor restarts the
stage. Spark looks for the answers of an exchange once a second, so a step takes a second at least: this form pays where a scan for each step would
take longer. Rows of a task lie in a file on its own disk and are read in parts, so its memory does not grow with them; a message carries the
parameters of every task. ``training.train``, a scan for each step, gives the same parameters.
"""

from __future__ import annotations

import base64
import json
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.plans.generation import gen_tabular, hashed
from larkspan.plans.optimizer import Adam, Gradient
from larkspan.plans.scoring import matrix
from larkspan.registry import query

HISTORY = "epoch int, loss double, accuracy double, n_train bigint, test_loss double, test_accuracy double, n_test bigint"


#: Rows of a task that are in memory at a time.
PART_ROWS = 1 << 15


class _Held:
    """The rows of a task in a temporary file on its own disk, which goes with the task; read again in parts of ``PART_ROWS``."""

    def __init__(self, batches: Iterator[pd.DataFrame], epochs: int):
        self.file, self.kind = tempfile.TemporaryFile(), None
        for b in batches:
            if not len(b):
                continue
            x = matrix(b["x"])
            if self.kind is None:
                self.kind = np.dtype([("x", x.dtype, x.shape[1:]), ("y", b["y"].dtype), ("teaches", bool), ("batch", np.int32, (epochs,))])
            rows = np.empty(len(b), self.kind)
            rows["x"], rows["y"], rows["teaches"] = x, b["y"].to_numpy(), b["teaches"].to_numpy(bool)
            if epochs:
                rows["batch"] = matrix(b["batch_of"])
            self.file.write(rows.tobytes())

    def parts(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while self.kind is not None and (data := self.file.read(self.kind.itemsize * PART_ROWS)):
            yield np.frombuffer(data, self.kind)


def train_in_barrier(
    data: DataFrame, start: np.ndarray, gradient: Gradient, epochs: int, rate: float, steps: int, tasks: int | None = None
) -> tuple[np.ndarray, list[tuple]]:
    """Mini-batch Adam over ``data(id, x, y, part)`` from the parameters ``start``; rows whose part is ``train`` teach, all others are scored at the end.
    In every epoch a row falls into one of ``steps`` batches by the hash of seed, epoch and id. Returns the parameters, and for each epoch loss, accuracy
    and number of the rows as their batch met them, then those of the other rows. Without rows to learn from there are no epochs."""
    tasks = tasks or data.sparkSession.sparkContext.defaultParallelism
    # with one batch an epoch every row falls into it
    batch_of = F.array(*[(hashed(F.lit(e), F.col("id")) % steps).cast("int") for e in range(1, epochs + 1)] if steps > 1 else []).cast("array<int>")
    rows = data.select("x", "y", (F.col("part") == "train").alias("teaches"), batch_of.alias("batch_of")).repartition(tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = BarrierTaskContext.get()
        held = _Held(batches, epochs if steps > 1 else 0)

        def over_all_tasks(theta: np.ndarray, chosen: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            """Gradient, loss, hits and rows, summed over all tasks in the order of their numbers."""
            vec = np.zeros(theta.size + 3)
            for part in held.parts():
                mine = chosen(part)
                if mine.any():
                    g, loss, hits = gradient(theta, part["x"][mine], part["y"][mine])
                    vec += np.concatenate([g, [loss, hits, mine.sum()]])
            told = context.allGather(base64.b64encode(vec.tobytes()).decode("ascii"))
            return np.sum([np.frombuffer(base64.b64decode(t)) for t in told], axis=0)

        theta, adam, history = start.copy(), Adam(start.size, rate), []
        for epoch in range(epochs):
            met = np.zeros(3)
            for step in range(steps):
                total = over_all_tasks(theta, lambda part: part["teaches"] & (part["batch"][:, epoch] == step) if steps > 1 else part["teaches"])
                if total[-1]:
                    met += total[-3:]
                    theta = adam.step(theta, total[:-3] / total[-1])
            if not met[2]:
                break
            history.append((epoch + 1, met[0] / met[2], met[1] / met[2], int(met[2])))
        loss, hits, n = over_all_tasks(theta, lambda part: ~part["teaches"])[-3:]
        tested = (loss / n, hits / n, int(n)) if n else (None, None, 0)
        if context.partitionId() == 0:
            yield pd.DataFrame({"theta": [theta.tobytes()], "history": [json.dumps([(*h, *tested) for h in history])]})

    told = rows.mapInPandas(run, "theta binary, history string", barrier=True).collect()
    if not told:  # a table known to be empty is not even scanned
        return start.copy(), []
    row = told[0]
    return np.frombuffer(bytes(row["theta"])), [tuple(h) for h in json.loads(row["history"])]


@dataclass(frozen=True)
class Network:
    """Layer sizes; with ``attention`` each feature is weighed by a softmax over the features before the first layer."""

    n_features: int
    hidden: tuple[int, ...]
    n_classes: int
    attention: bool = False

    def shapes(self) -> list[tuple[str, int, int]]:
        """Name, rows and columns of every layer's weights, in order; each has a bias for each row."""
        sizes = [self.n_features, *self.hidden, self.n_classes]
        names = [f"hidden_{i + 1}" for i in range(len(self.hidden))] + ["classes"]
        gate = [("attention", self.n_features, self.n_features)] if self.attention else []
        return gate + [(name, n_out, n_in) for name, n_in, n_out in zip(names, sizes, sizes[1:])]

    @property
    def size(self) -> int:
        return sum(n_out * (n_in + 1) for _, n_out, n_in in self.shapes())

    def unpack(self, theta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Weights and biases as views of ``theta``."""
        out, at = [], 0
        for _, n_out, n_in in self.shapes():
            w = theta[at : at + n_out * n_in].reshape(n_out, n_in)
            out.append((w, theta[at + n_out * n_in : at + n_out * (n_in + 1)]))
            at += n_out * (n_in + 1)
        return out

    def start(self, seed: int = 42) -> np.ndarray:
        """Weights spread evenly in proportion to the inputs of a layer, biases 0; the attention starts even."""
        rng, theta = np.random.default_rng(seed), np.zeros(self.size)
        for (name, _, n_in), (w, _) in zip(self.shapes(), self.unpack(theta)):
            if name != "attention":
                w[:] = rng.uniform(-1, 1, w.shape) * np.sqrt(6 / n_in)
        return theta

    def _forward(self, theta: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
        layers, shares = self.unpack(theta), None
        inputs = [x]
        if self.attention:
            w, b = layers.pop(0)
            shares = _softmax(x @ w.T + b)
            inputs = [x * shares * self.n_features]
        for w, b in layers[:-1]:
            inputs.append(np.maximum(inputs[-1] @ w.T + b, 0))
        w, b = layers[-1]
        return inputs[-1] @ w.T + b, inputs, shares

    def logits(self, theta: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._forward(theta, x)[0]

    def gradient(self, theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, int]:
        """Summed gradient of the cross-entropy, summed loss, right answers."""
        z, inputs, shares = self._forward(theta, x)
        p, rows = _softmax(z), np.arange(len(y))
        loss, hits = -np.log(np.clip(p[rows, y], 1e-12, None)).sum(), (p.argmax(axis=1) == y).sum()
        back = p
        back[rows, y] -= 1
        grad = np.zeros_like(theta)
        layers, grads = self.unpack(theta), self.unpack(grad)
        first = 1 if self.attention else 0
        for i in range(len(layers) - 1, first - 1, -1):
            own = inputs[i - first]
            grads[i][0][:] = back.T @ own
            grads[i][1][:] = back.sum(axis=0)
            back = back @ layers[i][0]
            if i > first:
                back = back * (own > 0)
        if self.attention:
            d_share = back * x * self.n_features
            d_score = shares * (d_share - (shares * d_share).sum(axis=1, keepdims=True))
            grads[0][0][:] = d_score.T @ x
            grads[0][1][:] = d_score.sum(axis=0)
        return grad, float(loss), int(hits)

    def as_table(self, spark: SparkSession, theta: np.ndarray) -> DataFrame:
        """``layer, name, row, col, value``; the bias of a row has col -1."""
        parts = []
        for i, ((name, n_out, n_in), (w, b)) in enumerate(zip(self.shapes(), self.unpack(theta))):
            row, col = np.divmod(np.arange(n_out * (n_in + 1)), n_in + 1)
            value = np.hstack([w, b[:, None]]).ravel()
            parts.append(pd.DataFrame({"layer": i, "name": name, "row": row, "col": np.where(col == n_in, -1, col), "value": value}))
        return spark.createDataFrame(pd.concat(parts), "layer int, name string, row int, col int, value double")

    def from_table(self, params: DataFrame) -> np.ndarray:
        """The parameters of a table, whatever the order of its rows; there are as many as the network has, which bounds what the driver receives."""
        theta = np.zeros(self.size)
        layers = self.unpack(theta)
        got = params.select("layer", "row", "col", "value").toArrow().to_pandas()
        if len(got) != self.size:
            raise ValueError(f"the network has {self.size} parameters, the table {len(got)}")
        for i, part in got.groupby("layer"):
            bias = part["col"] < 0
            layers[i][0][part["row"][~bias], part["col"][~bias]] = part["value"][~bias]
            layers[i][1][part["row"][bias]] = part["value"][bias]
        return theta


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def score(data: DataFrame, network: Network, params: DataFrame) -> DataFrame:
    """``data`` with ``prediction`` and ``probability`` of its ``x``, by the parameters of a table."""
    shared = data.sparkSession.sparkContext.broadcast(network.from_table(params))

    @F.pandas_udf("struct<prediction int, probability double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            p = _softmax(network.logits(shared.value, matrix(x))) if len(x) else np.empty((0, 1))
            yield pd.DataFrame({"prediction": p.argmax(axis=1) if len(x) else [], "probability": p.max(axis=1) if len(x) else []})

    return data.withColumn("__told", predict("x")).select(*data.columns, "__told.prediction", "__told.probability")


WIDTH = 6
TABULAR = Network(WIDTH, (32, 16), 2)
ATTENTIVE = Network(WIDTH, (16,), 2, attention=True)


def folded_classes(spark: SparkSession, d: str) -> DataFrame:
    """``id, x, y, part``: whether the first two features of a sample have the same sign, which no linear model tells. Four rows in five train."""
    from larkspan.plans.training import part_of

    f = F.col("features")
    same = (F.element_at(f, 1) > 0) == (F.element_at(f, 2) > 0)
    return gen_tabular(spark, d).select("id", F.slice(f, 1, WIDTH).alias("x"), same.cast("int").alias("y"), part_of("id").alias("part"))


def trained(spark: SparkSession, data: DataFrame, network: Network) -> tuple[DataFrame, DataFrame]:
    """The network's parameters as a table, and its history."""
    theta, history = train_in_barrier(data, network.start(), network.gradient, epochs=45, rate=0.06, steps=1)
    return network.as_table(spark, theta), spark.createDataFrame(history, HISTORY)


@query("score_network")
def score_network(spark: SparkSession, d: str) -> DataFrame:
    """Every sample scored by two hidden layers learned from four rows in five: prediction, probability, and the truth."""
    data = folded_classes(spark, d)
    params, _ = trained(spark, data, TABULAR)
    return score(data, TABULAR, params).select("id", "part", "y", "prediction", F.round("probability", 6).alias("probability"))


@query("score_attention")
def score_attention(spark: SparkSession, d: str) -> DataFrame:
    """The same by an attention over the features and one hidden layer."""
    data = folded_classes(spark, d)
    params, _ = trained(spark, data, ATTENTIVE)
    return score(data, ATTENTIVE, params).select("id", "part", "y", "prediction", F.round("probability", 6).alias("probability"))
