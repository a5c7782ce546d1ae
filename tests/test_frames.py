"""Range frames and running order statistics against plain versions: bursts, ties, nulls, one hot key, many pieces."""

from __future__ import annotations

import random

import numpy as np
import pytest

from larkspan.operators.frames import expanding_quantiles, range_frames, rolling_moments, rolling_quantiles

SCHEMA = "k string, t bigint, v double, id bigint"


def rows(n=400, hot=0.8):
    rnd = random.Random(7)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else rnd.choice(["a", "b", None])
        t = rnd.choice([rnd.randrange(1000), 500, 500 + rnd.randrange(10), rnd.randrange(-5, 5)])
        v = rnd.choice([None, round(rnd.uniform(-50, 50), 2), float(rnd.randrange(3)), float("nan") if i % 50 == 0 else 1.5])
        out.append((key, t, v, i))
    return out


def plain_frames(data, before, after):
    out = {}
    for k, t, _, i in data:
        if t is None:
            continue
        frame = [v for q, u, v, _ in data if q == k and u is not None and t - before <= u <= t + after]
        known = [v for v in frame if v is not None and v == v]
        out[i] = (len(frame), len(known), sum(known) if known else None, min(known, default=None), max(known, default=None))
    return out


@pytest.mark.parametrize("before, after", [(0, 0), (40, 0), (3, 7), (2000, 0), (0, 2000), (5000, 5000)])
@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_range_frames(spark, before, after, pieces):
    data = rows() + [("hot", None, 1.0, 9000)]
    got = range_frames(spark.createDataFrame(data, SCHEMA), ["k"], "t", "v", "id", before, after, pieces)
    want = plain_frames(data, before, after)
    found = {r["id"]: (r["n_rows"], r["n"], r["total"], r["least"], r["most"]) for r in got.collect()}
    assert found.keys() == want.keys()
    for i, w in want.items():
        assert found[i][:2] == w[:2] and found[i][3:] == w[3:]
        assert (found[i][2] is None) == (w[2] is None) and (w[2] is None or abs(found[i][2] - w[2]) < 1e-9)


def test_range_frames_without_keys_and_rows(spark):
    data = [("x", t, 1.0, t) for t in range(50)]
    got = range_frames(spark.createDataFrame(data, SCHEMA), [], "t", "v", "id", 10, 0, 8)
    assert {r["id"]: r["total"] for r in got.collect()} == {t: float(min(t, 10) + 1) for t in range(50)}
    assert range_frames(spark.createDataFrame([], SCHEMA), ["k"], "t", "v", "id", 10).count() == 0


@pytest.mark.parametrize("pieces", [1, 7])
def test_expanding_quantiles(spark, pieces):
    data = [(k, t, None if v is None or v != v else v, i) for k, t, v, i in rows(150)]
    probs = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = expanding_quantiles(spark.createDataFrame(data, SCHEMA), ["k"], ["t", "id"], "v", probs, pieces).collect()
    assert len(got) == len(data)
    for r in got:
        seen = [v for k, t, v, i in data if k == r["k"] and (t, i) <= (r["t"], r["id"]) and v is not None]
        for name, p in probs.items():
            assert (r[name] is None) == (not seen)
            assert not seen or abs(r[name] - np.quantile(seen, p)) < 1e-9
    assert expanding_quantiles(spark.createDataFrame([], SCHEMA), ["k"], ["t", "id"], "v", probs).count() == 0


def test_expanding_quantiles_of_small_keys_move_once(spark):
    """Small keys, large ones and those with values that are not finite agree with the descent, rows that come twice too; small ones have no descent."""
    big = [("big", t, float(t * 37 % 101), t) for t in range(60)]
    data = [(k, t, None if v is None or v != v else v, i) for k, t, v, i in rows(80)] + big + [("odd", 1, float("inf"), 2**60 + 1), ("odd", 2, float("nan"), 2**60 + 3)]
    df = spark.createDataFrame(data + data[::3] + [("n", 1, None, None)], SCHEMA)
    probs = {"q1": 0.25, "top": 1.0}
    ask = lambda key_rows: expanding_quantiles(df, ["k"], ["t", "id"], "v", probs, 5, key_rows)
    plain = lambda got: sorted((repr(tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r)) for r in got.collect()))
    assert plain(ask(0)) == plain(ask(40)) == plain(ask(1000))
    small = expanding_quantiles(spark.createDataFrame(big, SCHEMA), ["k"], ["t", "id"], "v", probs)
    text = small._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "rangepartitioning" not in text


@pytest.mark.parametrize("block", [3, 10_000])
def test_rolling_quantiles_and_moments(spark, block):
    import pandas as pd

    data = [(k, t, None if v is None or v != v else v, i) for k, t, v, i in rows(200)]
    table = spark.createDataFrame(data, SCHEMA)
    quantiles = {r["id"]: r for r in rolling_quantiles(table, ["k"], ["t", "id"], "v", 9, {"q1": 0.25, "mid": 0.5}, 4, block).collect()}
    moments = {r["id"]: r for r in rolling_moments(table, ["k"], ["t", "id"], "v", 9, block).collect()}
    frame = pd.DataFrame(data, columns=["k", "t", "v", "id"]).sort_values(["t", "id"])
    for _, own in frame.groupby("k", dropna=False):
        rolled = own["v"].astype(float).rolling(9, min_periods=4)
        for i, q1, mid in zip(own["id"], rolled.quantile(0.25), rolled.quantile(0.5)):
            for w, g in ((q1, quantiles[i]["q1"]), (mid, quantiles[i]["mid"])):
                assert (g is None) == bool(np.isnan(w)) and (g is None or abs(g - w) < 1e-9)
        values = own["v"].astype(float).to_numpy()
        for n, i in enumerate(own["id"]):
            part = pd.Series(values[max(0, n - 8) : n + 1]).dropna()
            for want, g in ((part.skew(), moments[i]["skew"]), (part.kurt(), moments[i]["kurt"])):
                flat = len(part) and part.max() == part.min()
                if flat or np.isnan(want):
                    assert g is None
                else:
                    assert abs(g - want) < 1e-6


def test_no_exchange_on_the_bare_key(spark):
    table = spark.createDataFrame(rows(50), SCHEMA)
    plan = range_frames(table, ["k"], "t", "v", "id", 10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" not in plan and "hashpartitioning(coalesce(__k0" not in plan
