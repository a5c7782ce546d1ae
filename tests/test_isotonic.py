"""Isotonic regression against pooling of adjacent violators, over many small ranges, with ties, weights and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from larkspan.plans import isotonic as iso


def pooled(rows):
    """x to value, by pooling from the left."""
    sums: dict[float, list[float]] = {}
    for x, y, w in rows:
        if None in (x, y, w) or not all(map(math.isfinite, (x, y, w))) or w <= 0:
            continue
        cell = sums.setdefault(float(x), [0.0, 0.0])
        cell[0] += w
        cell[1] += w * y
    pools = []
    for x in sorted(sums):
        pools.append([[x], *sums[x]])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            xs, w, s = pools.pop()
            pools[-1][0] += xs
            pools[-1][1] += w
            pools[-1][2] += s
    return {x: (s / w, xs[-1]) for xs, w, s in pools for x in xs}


def cases():
    rng = np.random.default_rng(3)
    n = 1500
    x = rng.permutation(n)
    yield "noisy", [(int(a), float(a / 50 + rng.normal() * 5), 1.0) for a in x]
    yield "rising", [(int(a), float(a), 1.0) for a in x]
    yield "falling", [(int(a), -float(a), 1.0) for a in x]
    yield "equal", [(int(a), 7.0, 1.0) for a in x]
    yield "ties and weights", [(int(a // 7), int(rng.integers(0, 9)) + int(a) // 300, int(rng.integers(1, 5))) for a in x]
    yield "one x", [(4, int(a), 1) for a in x]
    yield "dips late", [(int(a), float(a if a < 1200 else 1200 - 3 * (a - 1200)), 1.0) for a in x]
    yield "waves", [(int(a), round(40 * math.sin(a / 90)) + int(a) // 20, 1.0) for a in x]
    yield "steep", [(int(a), float(a) ** 3 - (1e9 if a == 1499 else 0), 1.0) for a in x]


@pytest.mark.parametrize("name, rows", list(cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_equals_pooling(spark, name, rows):
    df = spark.createDataFrame([(float(x), float(y), float(w)) for x, y, w in rows], "x double, y double, w double")
    want = pooled(rows)
    got = iso.isotonic(df, "x", "y", "w", range_rows=60).collect()
    assert len(got) == len(want)
    for r in got:
        value, last = want[r["x"]]
        assert r["fitted"] == pytest.approx(value, rel=1e-9, abs=1e-7)
        if name in ("equal", "ties and weights", "one x", "waves"):  # whole numbers: pools are exact
            assert r["pool"] == last
    assert sum(r["weight"] for r in got) == pytest.approx(sum(w for _, _, w in rows))


def test_falling_curve(spark):
    rng = np.random.default_rng(8)
    rows = [(float(i), float(round(rng.normal() * 9) - i // 30), 1.0) for i in range(400)]
    want = pooled([(x, -y, w) for x, y, w in rows])
    got = iso.isotonic(spark.createDataFrame(rows, "x double, y double, w double"), "x", "y", increasing=False, range_rows=30).collect()
    assert {r["x"]: pytest.approx(r["fitted"], abs=1e-9) for r in got} == {x: -v for x, (v, _) in want.items()}


def test_odd_rows_and_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 5.0, 1.0), (2.0, 3.0, 2.0), (None, 1.0, 1.0), (3.0, None, 1.0), (3.0, 1.0, None), (nan, 1.0, 1.0), (3.0, inf, 1.0), (4.0, 1.0, 0.0), (5.0, 1.0, -2.0), (0.0, nan, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, w double")
    assert sorted(iso.isotonic(df, "x", "y", "w").collect()) == [(1.0, 1.0, 5.0, pytest.approx(11 / 3), 2.0), (2.0, 2.0, 3.0, pytest.approx(11 / 3), 2.0)]
    assert iso.isotonic(df.limit(0), "x", "y").collect() == []


def test_few_points_reach_the_driver():
    """A hull shows both ends with their neighbours, and a number of points that grows with the logarithm of its size."""
    for n in (1, 2, 3, 5, 100, 1_000_000):
        at = iso._shown(n)
        assert {0, min(1, n - 1), max(n - 2, 0), n - 1} <= set(at.tolist()) and at.max() < n
        assert len(at) <= iso.SHOWN + 2 * n.bit_length()


def test_curve_query(spark, sf_dir):
    import __spark_entry__ as entry

    got = sorted(entry.queries()["isotonic_curve"](spark, sf_dir).collect())
    assert len(got) > 3
    assert all(a["x_to"] < b["x_from"] and a["value"] < b["value"] for a, b in zip(got, got[1:]))
