"""Isotonic regression as the lower convex hull of cumulative sums.

Values are summed by equal ``x`` and laid out in ranges of ``x``. The running weight and the running sum of weighted values are points of a curve, and the
pools of the regression are the edges of its lower convex hull. Each range finds the hull of its own points. What is left is to cut the ends of those
hulls where edges across ranges pass below them: in each round a range shows a bounded number of its points, the driver takes the hull of
those (no pool and no other point comes there), and all points on or above that hull go. Points of a range are shown evenly and ever denser towards its
ends, so a round at least halves what one end still has to lose; when a round loses none of the points shown, all corners are convex and the
hull is whole. A task holds one range, of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.skew import PIECE, in_pieces
from larkspan.plans.generation import N_INFORMATIVE, gen_tabular, normal
from larkspan.registry import query
from larkspan.session import write_table
from larkspan.sources.tables import table

#: Distinct values of x in a range, about.
RANGE_ROWS = 500_000
#: Evenly spaced points that a range shows in a round, besides those at its ends.
SHOWN = 32

POINTS = f"x double, upto_w double, upto_s double, {PIECE} int"


def lower_hull(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Indices of the corners of the lower convex hull; ``w`` ascends. Points on an edge are no corners."""
    keep: list[int] = []
    ws, ss = w.tolist(), s.tolist()
    for i in range(len(ws)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (ss[i] - ss[b]) * (ws[b] - ws[a]) > (ss[b] - ss[a]) * (ws[i] - ws[b]):
                break
            keep.pop()
        keep.append(i)
    return np.array(keep, dtype=int)


def _shown(n: int) -> np.ndarray:
    """Positions of the points that a hull of ``n`` corners shows: both ends and their neighbours always."""
    near = 2 ** np.arange(max(n, 1).bit_length()) - 1
    near = near[near < n]
    return np.unique(np.concatenate([np.linspace(0, n - 1, min(n, SHOWN)).astype(int), near, n - 1 - near]))


def _curve(before: dict[int, tuple[float, float]], own_hull: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Points of one range on the curve of running sums, or the corners of their hull."""

    def points(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        w, s = before[int(rows[PIECE].iloc[0])]
        rows = rows.assign(upto_w=w + rows["w"].cumsum(), upto_s=s + rows["s"].cumsum())
        return rows.iloc[lower_hull(rows["upto_w"].to_numpy(), rows["upto_s"].to_numpy())][["x", "upto_w", "upto_s", PIECE]] if own_hull else rows

    return points


def _below(w: np.ndarray, s: np.ndarray, lost: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of the corners of one range, those of the hull ``(w, s)`` and those below it."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["upto_w"].to_numpy()
        stays = np.isin(at, w) | ((rows["upto_s"].to_numpy() < np.interp(at, w, s)) & ~np.isin(at, lost))
        return rows[stays]

    return cut


def _fitted(ends: dict[int, tuple[tuple, tuple]], shift: float, sign: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Each x of a range with the edge of the hull it lies on; ``ends`` are the corners next to the range."""

    def fit(rows: pd.DataFrame, corners: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"x": [], "weight": [], "mean": [], "fitted": [], "pool": []}, dtype=float)
        first, last = ends[int(rows[PIECE].iloc[0])]
        corners = corners.sort_values("x")[["x", "upto_w", "upto_s"]].to_numpy()
        corners = np.vstack([first, corners, last]) if last else np.vstack([first, corners])
        x = rows["x"].to_numpy()
        at = np.searchsorted(corners[:, 0], x)
        step = corners[at] - corners[at - 1]
        value = step[:, 2] / step[:, 1]
        return pd.DataFrame({
            "x": x, "weight": rows["w"].to_numpy(), "mean": sign * (rows["s"] / rows["w"]).to_numpy() + shift, "fitted": sign * value + shift, "pool": corners[at, 0]})

    return fit


def isotonic(df: DataFrame, x: str, y: str, weight: str | None = None, increasing: bool = True, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``x, weight, mean, fitted, pool``: one row per distinct ``x`` with its total weight, its mean of ``y``, the value of the isotonic regression there and
    the largest x of its pool. ``increasing=False`` fits a falling curve.

    Rows whose x, y or weight is null, NaN or infinite, or whose weight is not above 0, take no part; without rows the result is empty. Neighbouring pools of equal
    value are one pool, unless sums that are no whole numbers differ by rounding. Weights below the rounding of their total (a share of 1e-15) cannot
    be told apart.
    """
    spark = df.sparkSession
    given = df.select(*[F.col(c).cast("double").alias(a) for c, a in ((x, "x"), (y, "y"))], (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    usable = [F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in ("x", "y", "w")]
    given = given.where(usable[0] & usable[1] & usable[2] & (F.col("w") > 0))
    sign = 1.0 if increasing else -1.0
    # a whole number is taken off y: sums stay small, and whole where y is whole
    sums = write_table(given.groupBy("x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("raw")), "isotonic-sums")
    n, total, raw = sums.agg(F.count("*"), F.sum("w"), F.sum("raw")).first()
    if not n:
        return spark.createDataFrame([], "x double, weight double, mean double, fitted double, pool double")
    shift = float(round(raw / total))
    sums = sums.select("x", "w", (sign * (F.col("raw") - F.col("w") * shift)).alias("s"))
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / range_rows))
    laid = in_pieces(sums, [], ["x"], pieces)
    # one row per range
    totals = sorted(laid.groupBy(PIECE).agg(F.sum("w"), F.sum("s")).collect())
    before, upto = {}, (0.0, 0.0)
    for piece, w, s in totals:
        before[piece] = upto
        upto = (upto[0] + w, upto[1] + s)

    hull = write_table(laid.groupBy(PIECE).applyInPandas(_curve(before, True), POINTS), "hull")
    shown = lambda rows: rows.sort_values("x").iloc[_shown(len(rows))]
    while True:
        seen = hull.groupBy(PIECE).applyInPandas(shown, POINTS).toPandas().sort_values([PIECE, "x"])
        w, s = (np.concatenate([[0.0], seen[c].to_numpy()]) for c in ("upto_w", "upto_s"))
        corners = lower_hull(w, s)
        if len(corners) == len(w):
            break
        lost = np.setdiff1d(np.arange(len(w)), corners)
        hull = write_table(hull.groupBy(PIECE).applyInPandas(_below(w[corners], s[corners], w[lost]), POINTS), "hull")

    by_piece = {int(p): rows[["x", "upto_w", "upto_s"]].to_numpy() for p, rows in seen.groupby(PIECE)}
    ends, last = {}, (-np.inf, 0.0, 0.0)
    for piece, _, _ in totals:
        ends[piece] = [last, None]
        last = tuple(by_piece[piece][-1]) if piece in by_piece else last
    following = None
    for piece, _, _ in reversed(totals):
        ends[piece] = (ends[piece][0], following)
        following = tuple(by_piece[piece][0]) if piece in by_piece else following
    fit = _fitted(ends, shift, sign)
    return laid.groupBy(PIECE).cogroup(hull.groupBy(PIECE)).applyInPandas(fit, "x double, weight double, mean double, fitted double, pool double")


@query(
    "isotonic_prices",
    """with t as (select date_diff('day', date '1970-01-01', o_orderdate::date) as day, count(*) as n, sum(round(o_totalprice * 100)::bigint)::bigint as cents from orders group by 1),
      r as (select day, n, cents, sum(n) over w as un, sum(cents) over w as uc from t window w as (order by day)),
      avgs as (select j.day as j, k.day as k, (k.uc - j.uc + j.cents)::double / (k.un - j.un + j.n)::double as a from r j join r k on k.day >= j.day),
      least_on as (select j, k, min(a) over (partition by j order by k desc) as m from avgs),
      fit as (select k as day, max(m) as f from least_on group by 1)
      select min(day)::bigint as first_day, max(day)::bigint as last_day, sum(n)::bigint as n_orders, sum(cents)::bigint as cents from fit join t using (day) group by f""",
)
def isotonic_prices(spark: SparkSession, d: str) -> DataFrame:
    """Pools of the rising curve nearest to the prices of orders by day: first and last day, orders and cents."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).alias("day")
    orders = table(spark, d, "orders").select(day, F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    pools = isotonic(orders, "day", "cents").select(F.col("x").cast("bigint").alias("day"), "pool")
    days = orders.groupBy("day").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return days.join(pools, "day").groupBy("pool").agg(
        F.min("day").cast("bigint").alias("first_day"), F.max("day").cast("bigint").alias("last_day"), F.sum("n").alias("n_orders"), F.sum("cents").alias("cents")).drop("pool")


@query("isotonic_curve")
def isotonic_curve(spark: SparkSession, d: str) -> DataFrame:
    """The rising curve nearest to a noisy mixed feature along the first feature of the generated samples, every sample with an x of its own: pools with their
    borders, weight and value."""
    t = gen_tabular(spark, d)
    noisy = F.col("features")[N_INFORMATIVE] + 0.3 * normal(F.col("id"), 77)
    fit = isotonic(t.select(F.col("features")[0].alias("x"), noisy.alias("y")), "x", "y")
    return fit.groupBy("pool").agg(F.min("x").alias("x_from"), F.max("x").alias("x_to"), F.sum("weight").alias("weight"), F.first("fitted").alias("value")).drop("pool")
