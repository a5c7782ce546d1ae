"""Embedding whitening by an incremental eigendecomposition.

Vectors are put on an integer grid, ``x = floor(scale * c) + shift``, so that counts, sums and deviations are exact at every size.

1. Every task keeps the spectrum of the rows it has seen: their number, their exact sums, and eigenvalues and eigenvectors of their scatter about
   their own mean. Rows arrive in blocks; a block, centred about its mean, is turned into its triangular factor, which has the
   same scatter in as many rows as there are dimensions, and each of these rows is a rank-one update of the eigenpairs: the
   roots of the secular equation between the old eigenvalues, after deflation of directions that do not change and of equal
   eigenvalues, and eigenvectors from the adjusted update vector (which keeps them orthogonal). One more update moves the mean.
   With ``block_rows=1`` every vector is an update of its own; its cost, cubic in the dimensions, is why blocks are larger.
2. Spectra are combined by the same updates, the eigenpairs of one into those of the other, ``FAN`` at a time, in rounds
   that are written to the shared folder.
3. One more pass takes the covariance in the combined basis, centred by the exact mean (Rayleigh-Ritz on the whole space), which
   gives eigenvectors and eigenvalues to double precision; a last pass measures the covariance of the whitened rows.

What travels is bounded by the number of dimensions: a spectrum, or half a square matrix, for each task. No row is moved.

Defined cases: a vector that is null, empty or holds null or non-finite entries has no rows in the result; so have vectors whose length differs from the most common
length (the longer one of two that are equally common); repeated rows count each, and give rows each; a null id stays null; other columns are
ignored; directions without variance (eigenvalue within rounding of 0) are no components, so a table of one vector, or of equal vectors, and an empty table give
no rows. Entries must stay below 2^52 / scale in size; larger ones stop the job.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.session import write_table

EPS = float(np.finfo(float).eps)
#: Spectra that are combined in one task of a round, and on the driver at the end.
FAN = 16


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum(weights / (poles - m))``, one behind each pole, for ascending poles and positive weights. Returned with the
    differences ``poles[j] - root[i]``, which are taken from the nearest pole and so are exact where they are small."""
    k = len(poles)
    last = np.arange(k) == k - 1
    gap = np.append(np.diff(poles), weights.sum())
    apart = poles[None, :] - poles[:, None]
    right = (1 + (weights / (apart - gap[:, None] / 2)).sum(1)) < 0
    origin = np.arange(k) + (right & ~last)
    apart = poles[None, :] - poles[origin][:, None]
    low = np.where(right & ~last, -gap / 2, np.where(right, gap / 2, 0.0))
    high = np.where(right & ~last, 0.0, np.where(right, gap, gap / 2))
    at = (low + high) / 2
    before, done = np.tri(k), np.zeros(k, bool)
    own, following = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    for _ in range(100):
        d = apart - at[:, None]
        term = weights / d
        left_sum = np.einsum("ij,ij->i", term, before)
        right_sum = term.sum(1) - left_sum
        f = 1 + left_sum + right_sum
        slope = term / d
        sl = np.einsum("ij,ij->i", slope, before)
        sr = slope.sum(1) - sl
        # what rounding of the terms and of the root itself leaves of f
        done |= np.abs(f) <= 8 * EPS * (1 + right_sum - left_sum + np.abs(at) * (sl + sr))
        if done.all():
            break
        low, high = np.where(f < 0, at, low), np.where(f < 0, high, at)
        dl, dr = d[own, own], d[own, following]
        with np.errstate(all="ignore"):
            # two poles with the slopes of both sides; behind the last pole one pole and a constant
            a = (dl + dr) * f - dl * dr * (sl + sr)
            b = dl * dr * f
            c = f - dl * sl - dr * sr
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(last, dl + dl * dl * sl / (f - dl * sl), step)
            new = at + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done |= new == at
        at = np.where(done, at, new)
    d = apart - at[:, None]
    return poles[origin] + at, np.where(d == 0, np.finfo(float).tiny, d)


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``vectors diag(values) vectors' + weight v v'``, values ascending."""
    z = vectors.T @ v
    size = float(np.linalg.norm(z))
    rho = weight * size * size
    if not rho > 0:
        return values, vectors
    z = z / size
    tol = 8 * EPS * max(float(np.abs(values).max()), rho)
    values, vectors = values.copy(), vectors.copy()
    edges = np.flatnonzero(np.concatenate([[True], np.diff(values) > tol, [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        part = float(np.linalg.norm(z[a:b]))
        if b - a > 1 and part > 0:  # equal eigenvalues: one reflection leaves a single direction to update
            turn = z[a:b].copy()
            turn[-1] += np.copysign(part, turn[-1])
            mirrored = -np.copysign(part, z[b - 1])
            turn /= np.linalg.norm(turn)
            vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ turn, turn)
            z[a:b] = 0
            z[b - 1] = mirrored
    moves = rho * np.abs(z) > tol
    if not moves.any():
        return values, vectors
    poles, z = values[moves], z[moves]
    roots, d = secular_roots(poles, rho * z * z)
    if len(poles) > 1:
        below = poles[:, None] - poles[None, :]
        np.fill_diagonal(below, 1.0)
        z = np.sqrt(np.abs(np.prod(-d / below, axis=0))) * np.sign(z)
    turned = (z / d).T
    turned /= np.linalg.norm(turned, axis=0)
    values[moves] = roots
    vectors[:, moves] = vectors[:, moves] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Rows seen, their exact sums (Python integers), and the eigenpairs of their scatter about their mean."""

    width: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None

    def __post_init__(self):
        self.sums = self.sums or [0] * self.width
        if self.values is None:
            self.values, self.vectors = np.zeros(self.width), np.eye(self.width)

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def _shift(self, n: int, sums: list[int]) -> None:
        """What joining ``n`` more rows with these sums adds because the two means differ."""
        if self.n and n:
            # both means as one exact fraction before it is rounded
            apart = np.array([(b * self.n - a * n) / (self.n * n) for a, b in zip(self.sums, sums)])
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n * n / (self.n + n))
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums)]

    def add(self, block: np.ndarray) -> None:
        """Rows of whole numbers."""
        n, sums = len(block), [int(s) for s in block.sum(0)]
        centred = block - np.array([s // n for s in sums])  # small whole numbers
        centred = centred - centred.mean(0)
        if n > 1:
            for row in np.linalg.qr(centred, mode="r") if n > self.width else centred:
                self.values, self.vectors = rank_one(self.values, self.vectors, row)
        self._shift(n, sums)

    def merge(self, other: Spectrum) -> None:
        """The eigenpairs of the other one by one, largest last, then the means."""
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self._shift(other.n, other.sums)


def usable(vector: Column) -> Column:
    """A vector with entries, all of them finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


@dataclass(frozen=True)
class Grid:
    scale: int = 1024
    shift: int = 100_000

    def points(self, column: pa.Array, width: int) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        x = np.floor(self.scale * flat)
        if len(x) and np.abs(x).max() >= 2.0**52:
            raise OverflowError("an entry is too large for the grid")
        return x.astype(np.int64).reshape(-1, width) + self.shift


def _blocks(batches: Iterator[pa.RecordBatch], column: str, width: int, grid: Grid, rows: int) -> Iterator[np.ndarray]:
    """Blocks of ``rows`` points, whatever the size of the batches."""
    waiting: list[np.ndarray] = []
    for batch in batches:
        points = grid.points(batch.column(column), width)
        for at in range(0, len(points), rows):
            waiting.append(points[at : at + rows])
            if sum(map(len, waiting)) >= rows:
                joined = np.concatenate(waiting)
                yield joined[:rows]
                waiting = [joined[rows:]]
    if waiting and sum(map(len, waiting)):
        yield np.concatenate(waiting)


def spectrum_of(vectors: DataFrame, width: int, grid: Grid, block_rows: int | None = None) -> Spectrum:
    """The spectrum of ``vectors(vector)``; one for each task, combined in rounds of ``FAN``, the last of them on the driver."""
    rows = block_rows or max(4 * width, (1 << 18) // width)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum(width)
        for block in _blocks(batches, "vector", width, grid, rows):
            found.add(block)
        if found.n:
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "state": [pickle.dumps(found)]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        found = pickle.loads(pdf["state"].iloc[0])
        for state in pdf["state"].iloc[1:]:
            found.merge(pickle.loads(state))
        return pd.DataFrame({"task": [int(pdf["task"].iloc[0]) // FAN], "state": [pickle.dumps(found)]})

    schema = "task bigint, state binary"
    states = write_table(vectors.select("vector").mapInArrow(of_task, schema), "spectra")
    while states.count() > FAN:
        states = write_table(states.groupBy(F.expr(f"task div {FAN}")).applyInPandas(merged, schema), "spectra")
    total = Spectrum(width)
    for row in states.orderBy("task").collect():
        state = pickle.loads(row["state"])
        if total.n:
            total.merge(state)
        else:
            total = state
    return total


def _centred(points: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n``, with whole numbers taken off before the fraction."""
    whole = np.array([s // n for s in sums])
    return (points - whole) - np.array([(s - n * int(w)) / n for s, w in zip(sums, whole)])


def covariance_in(vectors: DataFrame, width: int, grid: Grid, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """Covariance of the centred rows times ``basis``, summed by entry in Spark."""
    k = basis.shape[1]
    i, j = np.triu_indices(k)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for block in _blocks(batches, "vector", width, grid, 4096):
            y = _centred(block, n, sums) @ basis
            total += y.T @ y
            first += y.sum(0)
        yield pa.RecordBatch.from_pydict(
            {"i": np.append(i, np.full(k, -1)).astype(np.int32), "j": np.append(j, np.arange(k)).astype(np.int32), "s": np.append(total[i, j], first)}
        )

    rows = vectors.select("vector").mapInArrow(of_task, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out, first = np.zeros((k, k)), np.zeros(k)
    for row in rows:
        if row["i"] < 0:
            first[row["j"]] = row["s"] / n
        else:
            out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["s"] / n
    return out - np.outer(first, first)


@dataclass
class Whitening:
    """Fitted on ``n`` rows with exact ``sums``: all eigenvalues descending, the kept eigenvectors as columns, and the largest absolute entry of the whitened
    covariance minus the identity."""

    width: int
    grid: Grid
    n: int
    sums: list[int]
    values: np.ndarray
    kept: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(v / self.values.sum()) for v in self.values[: self.kept.shape[1]]]

    @property
    def factors(self) -> np.ndarray:
        return self.kept / np.sqrt(self.values[: self.kept.shape[1]])


def common_width(vectors: DataFrame) -> int | None:
    """The most common length, the longer one of equals."""
    row = vectors.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    return row["w"] if row else None


def fit(vectors: DataFrame, components: int = 8, grid: Grid = Grid(), block_rows: int | None = None) -> Whitening | None:
    """The whitening of ``vectors(vector)``, all usable; None for an empty table."""
    width = common_width(vectors)
    if width is None:
        return None
    vectors = vectors.where(F.size("vector") == width)
    found = spectrum_of(vectors, width, grid, block_rows)
    basis = np.linalg.qr(found.vectors)[0]
    values, turned = np.linalg.eigh(covariance_in(vectors, width, grid, found.n, found.sums, basis))
    values, turned = np.maximum(values[::-1], 0), (basis @ turned)[:, ::-1]
    keep = int((values[:components] > width * EPS * max(values[0], 1.0) * 16).sum())
    out = Whitening(width, grid, found.n, found.sums, values, turned[:, :keep])
    if keep:
        out.identity_error = float(np.abs(covariance_in(vectors, width, grid, out.n, out.sums, out.factors) - np.eye(keep)).max())
    return out


def deviations(points: np.ndarray, n: int, sums: list[int]) -> list[str]:
    """``sum((n x - S)^2)`` of each row, exact whatever its size, in decimal digits."""
    most = max(int(np.abs(points).max()) * n + max(map(abs, sums)), 1) if len(points) else 1
    kind = np.int64 if most * most * points.shape[1] < 2**63 else object
    apart = points.astype(kind) * n - np.array(sums, dtype=kind)
    return [str(x) for x in (apart * apart).sum(1)]


def whiten(table: DataFrame, model: Whitening | None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id_column, component, n, deviation decimal(38,0), whitened, explained, identity_error``: a row for each usable vector and component."""
    rows = usable_rows(table, id_column, vector_column)
    plain = table.sparkSession.createDataFrame([], table.select(id_column).schema)
    if model is None or not model.kept.shape[1]:
        return plain.select(
            id_column, F.lit(0).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
            F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"),
        )
    width, grid, n, sums, factors = model.width, model.grid, model.n, model.sums, model.factors

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = grid.points(batch.column("vector"), width)
            y = _centred(points, n, sums) @ factors
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(deviations(points, n, sums), pa.string()), pa.array(list(y), pa.list_(pa.float64()))], ["id", "deviation", "y"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    done = rows.where(F.size("vector") == width).mapInArrow(of_batch, f"id {kind}, deviation string, y array<double>")
    done = done.select("id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("y").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, model.explained)), F.col("at") + 1)
    return done.select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def usable_rows(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id, vector`` of the rows that can be used."""
    return table.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).where(usable(F.col("vector")))


def fit_and_whiten(table: DataFrame, components: int = 8, grid: Grid = Grid(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    return whiten(table, fit(usable_rows(table, id_column, vector_column), components, grid), id_column, vector_column)
