"""Blocked products and random-range decomposition against numpy, with small blocks so that many meet."""

from __future__ import annotations

import numpy as np
import pytest

from larkspan.plans import blocks as blk

SCHEMA = "i bigint, j bigint, v double"


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(blk, "BLOCK", 16)
    monkeypatch.setattr(blk, "MEETING", 3)
    monkeypatch.setattr(blk, "FAN_IN", 2)


def cells(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], SCHEMA)


def dense(df, shape, cols=("i", "j", "v"), first=0):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[cols[0]], r[cols[1]] - first] = r[cols[2]]
    return out


def falling(n, d, seed, rate=0.7):
    rng = np.random.default_rng(seed)
    u, _ = np.linalg.qr(rng.normal(size=(n, min(n, d))))
    v, _ = np.linalg.qr(rng.normal(size=(d, min(n, d))))
    return (u * 100 * rate ** np.arange(min(n, d))) @ v.T


@pytest.mark.parametrize("n, inner, m, share", [(70, 5, 50, 1.0), (20, 90, 33, 0.2), (40, 40, 40, 0.01)])
def test_product(spark, n, inner, m, share):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(-3, 4, s) * (rng.random(s) < share) for s in ((n, inner), (inner, m)))
    got = blk.multiply(blk.blocks(cells(spark, a)), blk.blocks(cells(spark, b)))
    assert (dense(got, (n, m)) == a @ b).all()


def test_cells_given_twice_and_odd_ones(spark):
    rows = [(0, 0, 1.0), (0, 0, 2.0), (5, 40, 4.0), (5, 40, -4.0), (None, 1, 1.0), (1, None, 1.0), (1, 1, None), (-1, -17, 2.0)]
    got = blk.blocks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [(-1, -2, [15], [15], [2.0]), (0, 0, [0], [0], [3.0])]


@pytest.mark.parametrize("n, d", [(150, 40), (40, 150)])
def test_leading_values_and_vectors(spark, n, d):
    a = falling(n, d, 5)
    values, left, right = blk.leading(cells(spark, a), 5)
    got = sorted(values.collect())
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    for r, want in zip(got, s):
        assert r["singular_value"] == pytest.approx(want, rel=1e-6)
        assert r["singular_value"] <= want * (1 + 1e-9) and want <= r["at_most"] * (1 + 1e-9)
    lv, rv = dense(left, (n, 5), ("i", "component", "v"), 1), dense(right, (d, 5), ("j", "component", "v"), 1)
    assert np.allclose(np.abs(np.sum(lv * u[:, :5], axis=0)), 1, atol=1e-6) and np.allclose(np.abs(np.sum(rv * vt[:5].T, axis=0)), 1, atol=1e-6)
    assert np.allclose(lv.T @ lv, np.eye(5), atol=1e-9) and np.allclose(rv.T @ rv, np.eye(5), atol=1e-9)
    assert np.allclose(a @ rv, lv * [r["singular_value"] for r in got], atol=1e-6)


def test_bounds_hold_without_decay(spark):
    a = np.random.default_rng(2).normal(size=(60, 50))
    s = np.linalg.svd(a, compute_uv=False)
    for r, want in zip(sorted(blk.leading(cells(spark, a), 3, extra=4, rounds=1)[0].collect()), s):
        assert r["singular_value"] <= want * (1 + 1e-9) and want <= r["at_most"] * (1 + 1e-9)


def test_low_rank_and_nothing(spark):
    low = np.outer(np.arange(1, 40), np.arange(1, 30)).astype(float)
    values, _, _ = blk.leading(cells(spark, low), 4)
    assert [r["singular_value"] for r in values.collect()] == [pytest.approx(np.linalg.norm(low))]
    for frame in blk.leading(spark.createDataFrame([], SCHEMA), 2):
        assert frame.count() == 0
    with pytest.raises(ValueError):
        blk.leading(cells(spark, low), 10)


def test_query_within_its_bounds(spark, sf_dir, duck, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(blk, "BLOCK", 1024)
    rows = duck.execute("select o_custkey, l_partkey, sum(l_quantity)::double from lineitem join orders on l_orderkey = o_orderkey group by all").fetchall()
    a = np.zeros((1 + max(r[0] for r in rows), 1 + max(r[1] for r in rows)))
    for i, j, v in rows:
        a[i, j] = v
    s = np.linalg.svd(a, compute_uv=False)
    got = sorted(entry.queries()["wide_svd"](spark, sf_dir).collect())
    assert len(got) == 10
    for r, want in zip(got, s):
        assert r["singular_value"] <= want * (1 + 1e-9) and want <= r["at_most"] * (1 + 1e-9)
        assert r["singular_value"] >= 0.97 * want


def test_few_cells_are_not_multiplied_as_dense_blocks(monkeypatch):
    """Blocks with one cell in a thousand: no dense product, and the cells of all pairs added up by place; full blocks are multiplied as such."""
    import pandas as pd

    rng, size, used = np.random.default_rng(3), 256, []
    kept = blk._dense
    monkeypatch.setattr(blk, "_dense", lambda *a: used.append(1) or kept(*a))

    def pairs(share):
        sides = [[np.where(rng.random((size, size)) < share, rng.integers(1, 9, (size, size)), 0).astype(float) for _ in range(2)] for _ in range(6)]
        rows = [(k % 2, 3, *(x for m in ms for x in (*(c.astype(np.int32) for c in np.nonzero(m)), m[np.nonzero(m)]))) for k, ms in enumerate(sides)]
        return sides, pd.DataFrame(rows, columns=["bi", "bj", "ci", "cj", "cv", "di", "dj", "dv"])

    for share, dense_ones in ((0.001, 0), (0.7, 12)):
        used.clear()
        sides, rows = pairs(share)
        out = pd.concat(blk._products(rows, size)).groupby(["i", "j"])["v"].sum()
        want = np.zeros((2 * size, size))
        for k, (a, b) in enumerate(sides):
            want[k % 2 * size : (k % 2 + 1) * size] += a @ b
        assert len(used) == dense_ones and len(out) == np.count_nonzero(want)
        assert all(want[i, j - 3 * size] == v for (i, j), v in out.items())


@pytest.mark.parametrize("meeting, work", [(64, 1 << 32), (1, 1 << 32), (64, 1_000)])
def test_sides_meet_once(spark, monkeypatch, meeting, work):
    """Blocks are not joined pair by pair; groups of too many cells or products are cut, full blocks among few cells are right, cells that cancel are absent."""
    monkeypatch.setattr(blk, "MEETING", meeting)
    monkeypatch.setattr(blk, "WORK", work)
    rng = np.random.default_rng(7)
    a, b = (np.where(rng.random(s) < 0.1, rng.integers(-3, 4, s), 0) for s in ((90, 50), (50, 70)))
    a[:40, 16:32], b[16:32, 20:64] = rng.integers(1, 4, (40, 16)), rng.integers(1, 4, (16, 44))
    a[85], b[:, 66] = 0, 0
    a[85, :2], b[:2, 66] = 1, (2, -2)
    got = blk.multiply(blk.blocks(cells(spark, a)), blk.blocks(cells(spark, b)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "JOIN" not in plan.upper() or (meeting, work) != (64, 1 << 32), plan
    rows = got.collect()
    assert len(rows) == np.count_nonzero(a @ b) and all((a @ b)[r["i"], r["j"]] == r["v"] for r in rows)


def test_narrow_blocks_are_neither_joined_nor_collected(spark, monkeypatch):
    """A join would let Spark broadcast a narrow matrix, held whole by the driver; factors come to it as few numbers, and rounds plan no cuts of their own."""
    monkeypatch.setattr(blk, "MEETING", 64)
    plans, write, places, cut = [], blk.write_table, blk._places, []

    def watched(df, name):
        if name == "blocks":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(blk, "write_table", watched)
    monkeypatch.setattr(blk, "_places", lambda a, b: cut.append(1) or places(a, b))
    a = falling(60, 40, 3)
    values, _, _ = blk.leading(cells(spark, a), 3, extra=4, rounds=2)
    assert [r["singular_value"] for r in sorted(values.collect())] == pytest.approx(np.linalg.svd(a, compute_uv=False)[:3], rel=1e-4)
    assert len(plans) > 10 and not any("Join" in p for p in plans) and len(cut) == 2
