"""Matrices of any width as blocks: products by block, triangular factors by a tree, leading singular values by a random range.

A matrix is a table ``i, j, v`` of cells; those that are absent are zero. Blocks are its cells grouped by row and column range, so a task holds few
blocks of each side, whatever the width. A product brings the blocks of some neighbouring inner ranges together, once for each side; where they hold too many cells they are cut on
both sides. What they give is summed by block of the result, as packed cells. The decomposition
multiplies the matrix with few random columns, several times over, until those columns span its leading directions, and keeps in the driver only triangular
factors as wide as the number of those columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.registry import query
from larkspan.session import write_table
from larkspan.sources.tables import tables

#: Rows and columns of a block: a dense one has 8 MB.
BLOCK = 1_024
#: Cells of one side that meet in one place, in sixteenths of the rows and columns of so many blocks: a million.
MEETING = 64
#: Products of two cells that one place makes, at most about.
WORK = 1 << 32
#: Products of two cells that a task holds at a time.
PRODUCTS = 1 << 21
#: A dense product of blocks does so many multiplications in the time that one of two single cells takes.
DENSE_GAIN = 64
#: Triangular factors that a task stacks at a time.
FAN_IN = 16
#: Numbers of triangular factors that the driver stacks itself.
DRIVER_NUMBERS = 1 << 16

CELLS = "i bigint, j bigint, v double"
BLOCKS = "bi bigint, bj bigint, ci array<int>, cj array<int>, cv array<double>"


def blocks(cells: DataFrame) -> DataFrame:
    """``bi, bj, ci, cj, cv`` of the cells ``i, j, v``: places from the block's corner and values, as lists. Cells given twice are added; null places or values and zeros go."""
    whole = cells.select(*[F.col(c).cast(t) for c, t in (("i", "bigint"), ("j", "bigint"), ("v", "double"))]).dropna()
    whole = whole.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")
    low = lambda c: F.pmod(c, F.lit(BLOCK)).cast("int").alias(c)
    high = lambda c: F.floor(F.col(c) / BLOCK).cast("bigint").alias(f"b{c}")
    placed = whole.select(high("i"), high("j"), low("i").alias("ci"), low("j").alias("cj"), F.col("v").alias("cv"))
    lists = placed.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_listed, BLOCKS)
    return write_table(lists, "blocks")


def _block(bi: int, bj: int, ci: np.ndarray, cj: np.ndarray, cv: np.ndarray) -> pa.RecordBatch:
    ends = pa.array([0, len(cv)], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (ci.astype(np.int32), cj.astype(np.int32), cv)]
    return pa.record_batch([pa.array([bi], pa.int64()), pa.array([bj], pa.int64()), *lists], names=["bi", "bj", "ci", "cj", "cv"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, of cells sorted by block."""
    held: list[pa.RecordBatch] = []

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        bi, bj, *cells = (np.concatenate([r.column(k).to_numpy(zero_copy_only=False) for r in rows]) for k in range(5))
        first = np.flatnonzero(np.r_[True, (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        ends = pa.array(np.r_[first, len(bi)].astype(np.int32))
        return pa.record_batch([pa.array(bi[first]), pa.array(bj[first]), *[pa.ListArray.from_arrays(ends, pa.array(c)) for c in cells]], names=["bi", "bj", "ci", "cj", "cv"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bi, bj = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        last = int(np.flatnonzero((bi != bi[-1]) | (bj != bj[-1]))[-1]) + 1 if bi[0] != bi[-1] or bj[0] != bj[-1] else 0
        if held and (last or held[-1].column(0)[-1].as_py() != bi[0] or held[-1].column(1)[-1].as_py() != bj[0]):
            yield done([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield done([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield done(held)


def _dense(i: np.ndarray, j: np.ndarray, v: np.ndarray, rows: int, columns: int) -> np.ndarray:
    out = np.zeros((rows, columns))
    out[i, j] = v
    return out


def _cells(bi: int, bj: int, m: np.ndarray, size: int) -> pd.DataFrame:
    i, j = np.nonzero(m)
    return pd.DataFrame({"i": bi * size + i, "j": bj * size + j, "v": m[i, j]})


def _sparse_product(pairs: list, size: int) -> pd.DataFrame:
    """Cells of the products of several pairs of blocks, added up by place: each cell of a left block meets the right block's cells in its inner place."""
    join = lambda name: np.concatenate([np.asarray(getattr(r, name)) for r in pairs])
    number = lambda name: np.repeat(np.arange(len(pairs)), [len(getattr(r, name)) for r in pairs])
    corners: dict[tuple[int, int], int] = {}
    corner = np.array([corners.setdefault((r.bi, r.bj), len(corners)) for r in pairs])
    left, right = number("cj"), number("di")
    inner, met = left * size + join("cj"), right * size + join("di")
    order = np.argsort(met, kind="stable")
    met, dj, dv = met[order], join("dj")[order], join("dv")[order]
    first = np.searchsorted(met, inner)
    n = np.searchsorted(met, inner, side="right") - first
    cell = np.repeat(np.arange(len(inner)), n)
    other = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n) + first[cell]
    place = (corner[left] * size + join("ci"))[cell] * size + dj[other]
    places, at = np.unique(place, return_inverse=True)
    v = np.bincount(at, weights=join("cv")[cell] * dv[other], minlength=len(places))
    places, v = places[v != 0], v[v != 0]
    of, i, j = places // size // size, places // size % size, places % size
    bi, bj = np.array(list(corners), dtype=np.int64).reshape(-1, 2).T
    return pd.DataFrame({"i": bi[of] * size + i, "j": bj[of] * size + j, "v": v})


def _products(rows: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Cells of the products of pairs of blocks: dense where that is faster, else cell by cell and many pairs at a time."""
    held, total = [], 0
    for r in rows.itertuples():
        n = int(np.bincount(r.di, minlength=size)[r.cj].sum())
        height, inner, width = r.ci.max() + 1, max(r.cj.max(), r.di.max()) + 1, r.dj.max() + 1
        if n > min(PRODUCTS, int(height) * int(inner) * int(width) // DENSE_GAIN):
            yield _cells(r.bi, r.bj, _dense(r.ci, r.cj, r.cv, height, inner) @ _dense(r.di, r.dj, r.dv, inner, width), size)
        elif n:
            if held and total + n > PRODUCTS:
                yield _sparse_product(held, size)
                held, total = [], 0
            held.append(r)
            total += n
    if held:
        yield _sparse_product(held, size)


def _packed(place: np.ndarray, v: np.ndarray, corners: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows ``bi, bj, at, v`` of cells by rising ``place``: the number of their block in ``corners``, then the place in it. Places and values are packed."""
    at, block = (place % (size * size)).astype(np.int32), place // (size * size)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, dtype=np.int64)
    ends = np.r_[first, len(at)].astype(np.int32)
    binary = lambda x: pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(np.ascontiguousarray(x))])
    bi, bj = corners[block[first]].T.copy()
    return pa.record_batch([pa.array(bi), pa.array(bj), binary(at), binary(v)], names=["bi", "bj", "at", "v"])


class _Side:
    """Blocks of one side of a group: ``b`` their ranges, ``n`` their cells; of each cell the block's number, the outer place, the inner place from ``low`` on and the value."""

    def __init__(self, rows: list[pa.RecordBatch], low: int, size: int):
        column = lambda c: np.concatenate([r.column(c).to_numpy(zero_copy_only=False) for r in rows])
        lists = lambda c: np.concatenate([r.column(c).flatten().to_numpy(zero_copy_only=False) for r in rows])
        self.b, self.range = column("b"), column("inner") - low
        self.n = np.concatenate([r.column("co").value_lengths().to_numpy(zero_copy_only=False) for r in rows]).astype(np.int64)
        self.block = np.repeat(np.arange(len(self.b)), self.n)
        self.outer, self.place, self.v = lists("co"), lists("cn"), lists("cv")
        self.inner = self.range[self.block] * size + self.place

    def taken(self, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Block, outer and inner place and value of the cells of some blocks."""
        cells = slice(None) if blocks.all() else blocks[self.block]
        return self.b[self.block[cells]], self.outer[cells], self.inner[cells], self.v[cells]

    def named(self, k: int, names: str) -> list:
        ends = np.cumsum(self.n)
        cells = slice(ends[k] - self.n[k], ends[k])
        return [(n, x[cells]) for n, x in zip(names.split(), (self.outer, self.place, self.v))]


def _met(left: tuple, right: tuple, size: int) -> Iterator[pa.RecordBatch]:
    """Packed products of the cells of both sides with the same inner place, added up by place in the result, half of ``PRODUCTS`` at a time."""
    order = np.argsort(right[2], kind="stable")
    rb, dj, met, dv = (x[order] for x in right)
    columns, rb = np.unique(rb, return_inverse=True)
    order = np.lexsort((left[1], left[0]))
    lb, ci, inner, cv = (x[order] for x in left)
    first = np.searchsorted(met, inner)
    n = np.searchsorted(met, inner, side="right") - first
    some = n > 0
    lb, ci, cv, first, n = (x[some] for x in (lb, ci, cv, first, n))
    ends, start = np.cumsum(n), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start] - n[start]) + PRODUCTS // 2, side="right")))
        part = slice(start, stop)
        rows, at = np.unique(lb[part], return_inverse=True)
        reach = np.repeat(first[part] - (ends[part] - n[part] - (ends[start] - n[start])), n[part]) + np.arange(ends[stop - 1] - ends[start] + n[start])
        row = (at * len(columns) * size + ci[part]) * size
        place = np.repeat(row, n[part]) + (rb * (size * size) + dj)[reach]
        v = np.repeat(cv[part], n[part]) * dv[reach]
        area = len(rows) * len(columns) * size * size
        if area <= 4 * len(place):
            total = np.bincount(place, weights=v, minlength=area)
            place = np.flatnonzero(total)
            v = total[place]
        else:
            place, to = np.unique(place, return_inverse=True)
            v = np.bincount(to, weights=v, minlength=len(place))
            place, v = place[v != 0], v[v != 0]
        yield _packed(place, v, np.stack([np.repeat(rows, len(columns)), np.tile(columns, len(rows))], axis=1), size)
        start = stop


def _group(sides: tuple[list, list], size: int) -> Iterator[pa.RecordBatch]:
    """Packed products of the blocks that meet. Blocks with one cell in sixteen or more on both sides may be faster as dense ones, a pair at a time."""
    if not all(sides):
        return
    low = min(int(r.column("inner").to_numpy().min()) for side in sides for r in side)
    left, right = (_Side(side, low, size) for side in sides)
    full = [s.n >= size * size // 16 for s in (left, right)]
    if full[0].any() and full[1].any():
        for k in np.flatnonzero(full[0]):
            for m in np.flatnonzero(full[1] & (right.range == left.range[k])):
                # corners of 0: frames then hold places in the block
                pair = pd.DataFrame({"bi": [0], "bj": [0], **{c: [x] for c, x in left.named(k, "ci cj cv") + right.named(m, "dj di dv")}})
                for cells in _products(pair, size):
                    yield _packed((cells["i"] * size + cells["j"]).to_numpy(), cells["v"].to_numpy(), np.array([[left.b[k], right.b[m]]]), size)
        lights = [(np.ones_like(full[0]), ~full[1]), (~full[0], full[1])]
    else:
        lights = [(np.ones_like(full[0]), np.ones_like(full[1]))]
    for mine, others in lights:
        if mine.any() and others.any():
            yield from _met(left.taken(mine), right.taken(others), size)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of rows with the same keys, in rows sorted by them, and whether the slice begins other keys than the last one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = np.r_[0, np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1, len(of)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield last is None or tuple(of[a]) != last, batch.slice(a, b - a)
            last = tuple(of[a])


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    sides: tuple[list, list] = ([], [])
    for new, rows in _runs(batches, ["near", "ca", "cb"]):
        if new:
            yield from _group(sides, size)
            sides = ([], [])
        right = rows.column("right").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            if (mine := rows.filter(pa.array(right == bool(k)))).num_rows:
                sides[k].append(mine)
    yield from _group(sides, size)


def _summed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of the result from packed cells: range of rows and of columns, places and values. A block of few cells sorts them, another adds them up in place."""
    whole: np.ndarray | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    corner, n = (0, 0), 0

    def done() -> tuple[int, int, np.ndarray, np.ndarray]:
        if whole is not None:
            at, v = np.arange(size * size), whole
        else:
            at, to = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            v = np.bincount(to, weights=np.concatenate([x for _, x in held]), minlength=len(at))
        some = np.flatnonzero(v)
        return *corner, at[some].astype(np.int64), v[some]

    for new, rows in _runs(batches, ["bi", "bj"]):
        if new:
            if n:
                yield done()
            whole, held, n = None, [], 0
            corner = (rows.column("bi")[0].as_py(), rows.column("bj")[0].as_py())
        for a, v in zip(rows.column("at"), rows.column("v")):
            a, v = np.frombuffer(a.as_buffer(), dtype=np.int32), np.frombuffer(v.as_buffer(), dtype=np.float64)
            n += len(a)
            if whole is None and n > size * size // 16:
                whole = np.zeros(size * size)
                for at, x in held:
                    whole[at] += x
                held = []
            if whole is None:
                held.append((a.copy(), v.copy()))
            else:
                whole[a] += v  # places of one row differ
    if n:
        yield done()


def _places(a: DataFrame, b: DataFrame) -> tuple[int, DataFrame | None]:
    """How many neighbouring inner ranges meet in a group, so that both sides have some ``MEETING`` cells, and ``near, ca, cb`` of groups to cut: into how many parts on
    each side."""
    most = MEETING * 16 * BLOCK
    many = lambda df, inner, outer, n, m: df.groupBy(F.col(inner).alias("inner")).agg(F.sum(F.size("cv")).alias(n), F.count("*").alias(m))
    ranges = write_table(many(a, "bj", "bi", "n", "bn").join(many(b, "bi", "bj", "m", "bm"), "inner"), "ranges")
    count, n, m = ranges.agg(F.count("*"), F.sum("n"), F.sum("m")).first()
    step = max(1, most * count // max(n, m)) if count else 1
    cells = lambda x, y, blocks: F.col(x).cast("double") * F.least(F.col(y), F.col(blocks) * BLOCK)
    near = ranges.groupBy(F.floor(F.col("inner") / step).alias("near")).agg(
        *[F.sum(c).alias(c) for c in ("n", "m", "bn", "bm")], F.sum(F.least(cells("n", "m", "bm"), cells("m", "n", "bn"))).alias("work"))
    cut = lambda c, blocks: F.least(F.ceil(F.col(c) / most * F.col("more")), F.col(blocks)).cast("int")
    more = F.greatest(F.lit(1.0), F.sqrt(F.col("work") / WORK))
    hot = write_table(near.withColumn("more", more).select("near", cut("n", "bn").alias("ca"), cut("m", "bm").alias("cb")).where("ca > 1 or cb > 1"), "hot")
    return step, None if hot.isEmpty() else hot


def _parts(a: DataFrame, b: DataFrame, places: tuple[int, DataFrame | None]) -> DataFrame:
    """Packed cells of the product, sorted by block; those of one place in the result are to be added."""
    step, hot = places
    size = BLOCK

    def side(df: DataFrame, outer: str, inner: str, right: bool) -> DataFrame:
        co, cn = ("cj", "ci") if right else ("ci", "cj")
        rows = df.select(F.floor(F.col(inner) / step).alias("near"), F.col(inner).alias("inner"), F.col(outer).alias("b"), F.col(co).alias("co"), F.col(cn).alias("cn"), "cv")
        one = F.lit(0)
        if hot is not None:
            mine, others = ("cb", "ca") if right else ("ca", "cb")
            rows = rows.join(F.broadcast(hot), "near", "left").withColumn(mine, F.pmod("b", F.coalesce(mine, F.lit(1))).cast("int"))
            rows = rows.withColumn(others, F.explode(F.sequence(one, F.coalesce(others, F.lit(1)) - 1)))
        else:
            rows = rows.withColumns({"ca": one, "cb": one})
        return rows.select("near", "ca", "cb", F.lit(right).alias("right"), "inner", "b", "co", "cn", "cv")

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _groups(batches, size)

    group, corner = ["near", "ca", "cb"], ["bi", "bj"]
    both = side(a, "bi", "bj", False).unionByName(side(b, "bj", "bi", True))
    parts = both.repartition(*group).sortWithinPartitions(*group).mapInArrow(multiplied, "bi bigint, bj bigint, at binary, v binary")
    return parts.repartition(*corner).sortWithinPartitions(*corner)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of the product of two matrices in blocks; cells that are zero are absent."""
    size = BLOCK

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, at, v in _summed(batches, size):
            yield pa.record_batch([pa.array(bi * size + at // size), pa.array(bj * size + at % size), pa.array(v)], names=["i", "j", "v"])

    return _parts(a, b, _places(a, b)).mapInArrow(cells, CELLS)


def product(a: DataFrame, b: DataFrame, places: tuple[int, DataFrame | None]) -> DataFrame:
    """The same product in blocks, as ``blocks`` would give it. ``places`` are those of the two or of sides with about as many cells at the same places."""
    size = BLOCK

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, at, v in _summed(batches, size):
            if len(at):
                yield _block(bi, bj, at // size, at % size, v)

    return write_table(_parts(a, b, places).mapInArrow(lists, BLOCKS), "blocks")




def _stacked(factors: Iterator[np.ndarray], width: int) -> pd.DataFrame:
    total = np.zeros((0, width))
    for m in factors:
        total = np.linalg.qr(np.vstack([total, m]), mode="r")
    return pd.DataFrame({"r": pd.Series([total.ravel()] if len(total) else [], dtype=object)})


def triangle(narrow: DataFrame, width: int) -> np.ndarray:
    """Triangular factor of a matrix in blocks with ``width`` columns at most, the number of a block's. Tasks reduce their rows, then stack each other's factors, ``FAN_IN`` a task,
    until one is left or few that are small."""
    size = BLOCK

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _stacked((_dense(r.ci, r.cj, r.cv, size, width) for rows in batches for r in rows.itertuples()), width)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _stacked((r.reshape(-1, width) for rows in batches for r in rows["r"]), width)

    parts = write_table(narrow.mapInPandas(first, "r array<double>"), "factors")
    n = parts.count()
    while n > 1 and not (n <= FAN_IN and n * width * width <= DRIVER_NUMBERS):
        n = math.ceil(n / FAN_IN)
        parts = write_table(parts.repartition(n).mapInPandas(merged, "r array<double>"), "factors")
        n = parts.count()
    (r,) = _stacked((np.array(r["r"]).reshape(-1, width) for r in parts.collect()), width)["r"].tolist() or [np.zeros(0)]
    return r.reshape(-1, width)


def times(narrow: DataFrame, m: np.ndarray) -> DataFrame:
    """A matrix in blocks, of one column range, times a small one, in blocks."""
    width, size = len(m), BLOCK

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ci, cj, cv = (rows.column(c) for c in ("ci", "cj", "cv"))
            for k, bi in enumerate(rows.column("bi").to_pylist()):
                got = _dense(*(c[k].values.to_numpy(zero_copy_only=False) for c in (ci, cj, cv)), size, width) @ m
                i, j = np.nonzero(got)
                if len(i):
                    yield _block(bi, 0, i, j, got[i, j])

    return narrow.mapInArrow(turned, BLOCKS)


def orthonormal(narrow: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Blocks with orthonormal columns that span those of ``narrow``, and how many there are. Done twice: the second pass takes away what rounding left in the first."""
    for _ in range(2):
        _, s, vt = np.linalg.svd(triangle(narrow, width), full_matrices=False)
        kept = int((s > s[0] * 1e-12).sum()) if len(s) and s[0] > 0 else 0
        narrow = write_table(times(narrow, vt[:kept].T / s[:kept]), "blocks")
        width = kept
        if not kept:
            break
    return narrow, width


def leading(cells: DataFrame, k: int, extra: int = 10, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ``k`` largest singular values of a matrix: ``component, singular_value, at_most``; then cells ``i, component, v`` of the left and ``j, component, v`` of
    the right singular vectors. The true value of a component is at least ``singular_value`` and at most ``at_most``, but for rounding: what the range leaves of the
    matrix is known from the sums of squares. Fewer components come out where the rank is lower, none for an empty or zero matrix. A vector's sign is arbitrary.

    More ``rounds`` narrow the bounds; each reads the matrix twice. ``k + extra`` is the number of a block's columns at most. Values must be finite.
    """
    spark, width = cells.sparkSession, k + extra
    if not 1 <= k or width > BLOCK:
        raise ValueError(f"k must be at least 1 and k + extra at most {BLOCK}")
    a = blocks(cells)
    at = a.select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), F.col("cj").alias("ci"), F.col("ci").alias("cj"), "cv")
    total = a.agg(F.sum(F.aggregate("cv", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 0.0
    signs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")))
    start = a.select("bj", F.explode(F.array_distinct("cj")).alias("j")).select((F.col("bj") * BLOCK + F.col("j")).alias("i")).distinct().select("i", signs.alias("j"))
    basis = blocks(start.withColumn("v", 1.0 - 2.0 * F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(2))))
    down = _places(a, basis)
    found, n = orthonormal(product(a, basis, down), width)
    across = _places(at, found)
    for _ in range(rounds if n else 0):
        other, n = orthonormal(product(at, found, across), n)
        found, n = orthonormal(product(a, other, down), n)
    vectors = "{} bigint, component int, v double"
    if not n:
        empty = lambda s: spark.createDataFrame([], s)
        return empty("component int, singular_value double, at_most double"), empty(vectors.format("i")), empty(vectors.format("j"))
    onto = product(at, found, across)
    _, s, vt = np.linalg.svd(triangle(onto, n), full_matrices=False)
    m = min(k, int((s > s[0] * 1e-12).sum()))
    left_out = max(0.0, total - float((s**2).sum()))
    values = spark.createDataFrame([(c + 1, float(x), math.sqrt(x * x + left_out)) for c, x in enumerate(s[:m])], "component int, singular_value double, at_most double")
    flat = lambda narrow: narrow.select("bi", F.explode(F.arrays_zip("ci", "cj", "cv")).alias("c"))
    named = lambda narrow, c: flat(narrow).select((F.col("bi") * BLOCK + F.col("c.ci")).alias(c), (F.col("c.cj") + 1).alias("component"), F.col("c.cv").alias("v"))
    return values, named(times(found, vt[:m].T), "i"), named(times(onto, vt[:m].T / s[:m]), "j")


def bought(spark: SparkSession, d: str) -> DataFrame:
    """Cells of customers by parts: the quantity ordered."""
    orders, lines = tables(spark, d, "orders", "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(
    "block_product",
    """with a as (select o_custkey as i, l_partkey as k, sum(l_quantity) as x from lineitem join orders on l_orderkey = o_orderkey group by all),
      b as (select l_partkey as k, l_suppkey as j, count(*) as y from lineitem group by all)
      select i as customer, j as supplier, sum(x * y)::double as reach from a join b using (k) group by all having sum(x * y) <> 0""",
)
def block_product(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by customer and part times lines by part and supplier, as blocks."""
    (lines,) = tables(spark, d, "lineitem")
    sold = lines.groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.count("*").alias("v"))
    return multiply(blocks(bought(spark, d)), blocks(sold)).where("v <> 0").select(F.col("i").alias("customer"), F.col("j").alias("supplier"), F.col("v").alias("reach"))


@query("wide_svd")
def wide_svd(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest singular values of customers by parts, each with its upper bound. All but the first are close to each other, which takes more rounds."""
    return leading(bought(spark, d), 10, rounds=6)[0]
