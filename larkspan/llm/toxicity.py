"""Toxicity scoring by averaged subword embeddings and a linear softmax.

A text is the bag of its distinct character n-grams inside word borders, hashed into buckets. Each bucket has a vector;
the weighted mean of a text's vectors goes through a linear layer and a softmax. Vectors and layer are trained together, in
numpy, by Adam on mini-batches. A misspelt word shares most n-grams with the word it stands for, and so its vectors.
Rare buckets weigh more than common ones (smooth inverse frequency over the training sample).

Training takes at most ``max_train`` labelled rows, those with the smallest hash of their doc_id; scoring reads every text, whole, in
Arrow batches. Once trained, the layer is folded into the vectors: a text's logit is a weighted mean of one number per bucket.

Defined cases: null and empty texts, and texts without letters, get the share of label 1 among the training rows; without
training rows every score is 0; several labels of one document count as their largest; labels that are null do not count;
repeated rows are scored each; a null doc_id is scored and never held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.labelled import training_labels

BITS = 17
SIZES = (3, 4, 5)
_PART = 1 << 18  # code points worked on at a time; parts overlap by the longest n-gram
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets(text: str | None) -> np.ndarray:
    """The distinct n-gram buckets of a text, sorted."""
    points = code_points(f" {(text or '').lower()} ")
    points = np.where(letters()[points], points, 0).astype(np.uint32)
    seen = np.zeros(1 << BITS, bool)
    for at in range(0, max(1, len(points) - 1), _PART):
        part = points[at : at + _PART + max(SIZES)]
        word = part != 0
        code = part.copy()
        inner = np.ones(len(part), bool)
        for n in range(2, max(SIZES) + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            code = (code[:m] * np.uint32(0x01000193)) ^ part[n - 1 :]
            if n > 2:
                inner = inner[:m] & word[n - 2 : n - 2 + m]
            if n in SIZES:
                hashed = (code[inner[:m]] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                seen[hashed >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """``logit`` and ``weight`` by bucket, the bias, and the share of label 1."""

    logit: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def mean(self, bag: np.ndarray) -> float:
        w = self.weight[bag]
        return float(w @ self.logit[bag]) / max(float(w.sum()), 1e-9)

    def score(self, bag: np.ndarray) -> float:
        if not len(bag):
            return self.prior
        z = self.mean(bag) + self.bias
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 17, **options) -> Model:
    """A model trained on four fifths of the rows, its logit then shifted to the cut that is best on the last fifth: vectors that tell all
    training texts apart are too sure of themselves on others."""
    last = np.random.default_rng(seed).random(len(bags)) < 0.2
    model = train([bags[i] for i in np.flatnonzero(~last)], labels[~last], seed=seed, **options)
    y = labels[last]
    model.prior = float(labels.mean()) if len(labels) else 0.0
    if len(y) < 20 or y.min() == y.max():
        return model
    z = np.array([model.mean(bags[i]) for i in np.flatnonzero(last)])
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.append(0, np.cumsum(y)) + np.append(np.cumsum((1 - y)[::-1])[::-1], 0)
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[len(best) // 2])
    cut = (z[max(i - 1, 0)] + z[min(i, len(z) - 1)]) / 2
    scale = 2.0 / max(float(z.std()), 1e-6)
    model.logit, model.bias = (model.logit * scale).astype(np.float32), -float(cut) * scale
    return model


def train(
    bags: list[np.ndarray], labels: np.ndarray, dim: int = 8, epochs: int = 20, batch: int = 64, rate: float = 0.02, scale: float = 30.0, seed: int = 17,
    min_texts: int = 3, smooth: float = 0.02, drop: float = 0.8
) -> Model:
    """Vectors E and softmax layer W, b: softmax(scale * mean(E[bag]) W + b). A step sees one part in five of each bag, drawn anew, so
    that no text is learnt by heart; buckets of fewer than ``min_texts`` texts are left out of every mean."""
    n, size = len(bags), 1 << BITS
    prior = float(labels.mean()) if n else 0.0
    if not n or prior in (0.0, 1.0):
        return Model(np.zeros(size, np.float32), np.ones(size, np.float32), 50.0 * prior - 25.0, prior)
    found = np.zeros(size)
    for bag in bags:
        found[bag] += 1
    weight = np.where(found >= min_texts, smooth / (smooth + found / n), 0).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (size, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.log([1 - prior, prior]).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, every = 0, np.arange(n)
    steps = epochs * -(-n // batch)
    for _ in range(epochs):
        rng.shuffle(every)
        for at in range(0, n, batch):
            rows = every[at : at + batch]
            rows = rows[[len(bags[i]) > 0 for i in rows]]
            if not len(rows):
                continue
            drawn = [b[rng.random(len(b)) >= drop] if len(b) > 8 else b for b in (bags[i] for i in rows)]
            drawn = [b if len(b) else bags[i] for b, i in zip(drawn, rows)]
            ids = np.concatenate(drawn)
            count = np.array([len(b) for b in drawn])
            begin = np.append(0, np.cumsum(count)[:-1])
            w = weight[ids]
            share = w / np.repeat(np.maximum(np.add.reduceat(w, begin), 1e-9), count)
            mean = scale * np.add.reduceat(params[0][ids] * share[:, None], begin)
            z = mean @ params[1] + params[2]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            back = scale * (p @ params[1].T)
            spread = share[:, None] * np.repeat(back, count, axis=0)
            own, place = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(place, spread[:, j], len(own)) for j in range(dim)], 1).astype(np.float32)
            step += 1
            now = rate * (1 - (step - 1) / steps)
            for k, g in ((0, grad), (1, mean.T @ p), (2, p.sum(0))):
                at_k = own if k == 0 else slice(None)
                first[k][at_k] = 0.9 * first[k][at_k] + 0.1 * g
                second[k][at_k] = 0.99 * second[k][at_k] + 0.01 * g * g
                params[k][at_k] -= now * (first[k][at_k] / (1 - 0.9**step)) / (np.sqrt(second[k][at_k] / (1 - 0.99**step)) + 1e-6)
    vectors, layer, bias = params
    unseen = found == 0
    vectors[unseen] = 0
    return Model((scale * vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), weight, float(bias[1] - bias[0]), prior)


def train_on(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> Model:
    """The model for ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; the driver receives the bags of ``max_train`` texts at most."""
    wanted = F.broadcast(training_labels(labels, "toxic", max_train))  # two numbers for each of max_train rows
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "bag": [buckets(t).tobytes() for t in pdf["text"]]})

    bags = rows.mapInPandas(bag, "doc_id bigint, y int, bag binary").orderBy("doc_id")
    found = [(np.frombuffer(bytes(r["bag"]), np.int32), r["y"]) for r in bags.toLocalIterator()]  # a partition at a time
    return fit([b for b, _ in found], np.array([y for _, y in found], np.int64))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column score, the probability of label 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[c for c in docs.columns if c.lower() != "score"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            yield pdf.assign(score=np.array([model.score(buckets(t)) for t in pdf["text"]], float))

    return docs.mapInPandas(score, docs.withColumn("score", F.lit(0.0)).schema)
