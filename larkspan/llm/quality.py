"""Quality scoring by histogram gradient-boosted trees over document statistics.

A text becomes some thirty statistics (lengths, shares of kinds of characters, shapes of words and lines, repetition). Their
values are cut into at most 64 bins at quantiles of the training rows; each tree is grown level by level from histograms of
gradients, in numpy. All trees are flattened into arrays of features, cuts and leaf values of full binary trees, so
a batch of texts walks through all of them by array operations.

Training takes at most ``max_train`` labelled rows, those with the smallest hash of their doc_id; statistics are computed from whole
texts.

Defined cases: null and empty texts have statistics of zero and are scored like any other; without training rows every score is 0;
several labels of one document count as their largest; labels that are null do not count; repeated rows are scored each; a null
doc_id is scored and never held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.labelled import training_labels

STATS = (
    "chars", "words", "lines", "word_mean", "word_deviation", "short_words", "long_words", "letters", "digits", "spaces", "upper",
    "marks", "symbols", "other", "bars", "symbol_words", "mark_words", "upper_words", "title_words", "line_mean", "line_deviation",
    "ended_lines", "bullet_lines", "repeated_lines", "distinct_words", "top_word", "same_next_word", "repeated_pairs", "distinct_chars",
    "sentence_mean", "stop_words",
)
#: Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    b"the of and to in is that for on with as was de la que el en los del las por un una le les et des est dans du pour sur der die das und "
    b"ist von den mit ein eine auf im zu".split()
)
_KIND = np.full(256, 7, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 mark, 5 symbol, 6 other control, 7 beyond ASCII
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:!?'\"()-" else 5 if _c.isprintable() else 6


def _spread(x: np.ndarray) -> tuple[float, float]:
    return (float(x.mean()), float(x.std())) if len(x) else (0.0, 0.0)


def statistics(text: str | None) -> list[float]:
    """The values of ``STATS`` for one text, from its UTF-8 bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(STATS)
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=8) / n
    words = data.split()
    count = len(words) or 1
    size = np.fromiter(map(len, words), np.int64, len(words))
    mean, deviation = _spread(size)
    lines = data.split(b"\n")
    line_size = np.fromiter(map(len, lines), np.int64, len(lines))
    line_mean, line_deviation = _spread(line_size)
    ends = np.flatnonzero((_KIND[raw] != 3) & (np.append(_KIND[raw[1:]], 3) == 3))  # last byte of each word
    starts = np.flatnonzero((_KIND[raw] != 3) & (np.append(3, _KIND[raw[:-1]]) == 3))
    end_kind, start_kind = _KIND[raw[ends]], _KIND[raw[starts]]
    second = _KIND[raw[np.minimum(starts + 1, n - 1)]]
    common = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    full = [x for x in (line.strip() for line in lines) if x]
    stops = sum(c for w, c in common.items() if w.lower() in STOP_WORDS)
    sentences = data.count(b".") + data.count(b"!") + data.count(b"?")
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), mean, deviation, float((size <= 2).sum()) / count,
        float((size >= 15).sum()) / count, float(kinds[0] + kinds[1]), float(kinds[2]), float(kinds[3]), float(kinds[1]), float(kinds[4]),
        float(kinds[5]), float(kinds[6] + kinds[7]), data.count(b"|") / count, float((end_kind == 5).sum()) / count, float((end_kind == 4).sum()) / count,
        float(((start_kind == 1) & (second == 1)).sum()) / count, float(((start_kind == 1) & (second != 1)).sum()) / count,
        line_mean, line_deviation, sum(x.endswith((b".", b"!", b"?")) for x in full) / max(len(full), 1),
        sum(x.startswith((b"-", b"*", b"#", b"|")) for x in full) / max(len(full), 1), 1 - len(set(full)) / max(len(full), 1),
        len(common) / count, max(common.values(), default=0) / count, sum(a == b for a, b in zip(words, words[1:])) / count,
        1 - len(pairs) / max(len(words) - 1, 1), float((np.bincount(raw, minlength=256) > 0).sum()), len(words) / (sentences + 1), stops / count,
    ]


@dataclass
class Forest:
    """Full binary trees of one depth as arrays: feature and cut by (tree, node), value by (tree, leaf). ``start`` is the log-odds
    before the first tree."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            while_nodes = len(feature)
            depth = while_nodes.bit_length()
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += value[node - while_nodes]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 2.0) -> Forest:
    """Logistic loss, second-order gains, one level of all nodes at a time."""
    n, width = x.shape if len(x) else (0, len(STATS))
    nodes, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, leaves))
    share = float(y.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return Forest(feature[:0], cut[:0], value[:0], 60.0 * share - 30.0)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)], 1)  # bin b: cuts[b-1] < x <= cuts[b]
    flat = binned + bins * np.arange(width)
    logit = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        grad, curve = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (bins * width) + flat).ravel()
            g = np.bincount(place, np.repeat(grad, width), here * bins * width).reshape(here, width, bins)
            h = np.bincount(place, np.repeat(curve, width), here * bins * width).reshape(here, width, bins)
            gl, hl = g.cumsum(2), h.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = ga - gl, ha - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least * 0.05) | (hr < least * 0.05)] = 0
            for j in range(width):
                gain[:, j, len(cuts[j]) :] = 0
            best = gain.reshape(here, -1).argmax(1)
            for k in range(here):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6:
                    feature[t, first + k], cut[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > cut[t][node])
        leaf = node - nodes
        value[t] = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, curve, leaves) + ridge)
        logit += value[t][leaf]
    return Forest(feature, cut, value, start)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with stats array<double>; a column of that name is replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("text", "stats")]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[kept].assign(stats=[statistics(t) for t in pdf["text"]])

    return docs.select(*kept, "text").mapInPandas(measure, docs.select(*kept).withColumn("stats", F.array(F.lit(0.0))).schema)


def train_on(stats: DataFrame, labels: DataFrame, max_train: int = 20_000) -> Forest:
    """The trees for ``stats(doc_id, stats)`` and ``labels(doc_id, quality)``; the driver receives ``max_train`` rows at most."""
    wanted = F.broadcast(training_labels(labels, "quality", max_train))  # two numbers for each of max_train rows
    rows = stats.select("doc_id", "stats").join(wanted, "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.max("y").alias("y"))
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return train(np.array([r["stats"] for r in found], float), np.array([r["y"] for r in found], float))


def score_quality(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with a column score instead of the statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    kept = [c for c in stats.columns if c.lower() not in ("stats", "score")]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["stats"].tolist(), float).reshape(len(pdf), len(STATS))
            yield pdf[kept].assign(score=shared.value.score(x))

    return stats.select(*kept, "stats").mapInPandas(score, stats.select(*kept).withColumn("score", F.lit(0.0)).schema)
