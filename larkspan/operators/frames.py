"""Frames that are cut by rows, not by time: range frames of any width, and order statistics over running frames, exact with all rows on one key.

**Range frames.** Every row asks for the rows of its key between two bounds. The bounds are laid out by range together with the rows, so a piece holds
a bounded number of rows and bounds whatever the key, its bursts and its ties. A piece answers the frames that lie inside it by a sparse
table of extremes and by running sums. A frame that spans pieces is the rest of its first piece, the head of its last one, and the totals of
those between: along a key both ends only move forward, so there are at most two pairs of pieces for each piece, and each is looked up once.

**Order statistics of running frames.** The values of a key get their rank; the quantile of the first n rows of a key is then a descent over the bits of
the rank: at each level the rows are counted that came before and whose rank begins with the bits found so far. All questions of a level
are answered at once by running counts over (key, bits, position), laid out by range, so a hot key is split at every level and the work
is rows times the bits of the largest group.

**Order statistics and moments of bounded frames** work on blocks of rows with a copied border, as all bounded frames of the library.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.operators.skew import PIECE, drop_halo, in_pieces, null_safe_join, positions, prefix, with_halo
from larkspan.session import write_table

_FACTS = "n bigint, total double, least double, most double"


def _sparse(values: np.ndarray, pick) -> list[np.ndarray]:
    """For each power of two the extreme of as many values from each position on."""
    table = [values]
    while 2 ** len(table) <= len(values):
        half = 2 ** (len(table) - 1)
        table.append(pick(table[-1][:-half], table[-1][half:]))
    return table


def _extreme(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, pick) -> np.ndarray:
    """The extreme of ``values[lo:hi]`` for each pair, NaN where there is none."""
    out = np.full(len(lo), np.nan)
    level = np.frexp(np.maximum(hi - lo, 1).astype(float))[1] - 1
    for k in np.unique(level):
        at = np.flatnonzero((level == k) & (hi > lo))
        out[at] = pick(table[k][lo[at]], table[k][hi[at] - 2**k])
    return out


def _answered(pdf: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """One piece, as it comes: ``side`` -1 for a lower bound, 0 for a row, 1 for an upper bound. Gives for each frame with a bound here the facts of its
    part in the piece; ``kind`` tells whether that is all of it (0), its begin (-1) or its end (1)."""
    group = pdf.groupby(list(keys), dropna=False, sort=False).ngroup() if keys else 0
    pdf = pdf.assign(group=group).sort_values(["group", "at", "side", "id"], kind="stable", ignore_index=True)
    side, group = pdf["side"].to_numpy(), pdf["group"].to_numpy()
    is_row = side == 0
    value = pdf["value"].to_numpy(float)[is_row]
    known = ~np.isnan(value)
    upto = np.append(0, np.cumsum(is_row))  # rows before each place
    begin = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")

    asked = np.flatnonzero(~is_row)
    part = pd.DataFrame({"id": pdf["id"].to_numpy()[asked], "side": side[asked], "at": upto[asked], "first": upto[begin[asked]], "last": upto[end[asked]], "place": asked})
    low, high = part[part["side"] < 0], part[part["side"] > 0]
    both = low.merge(high, on="id", suffixes=("", "_high"), how="outer", indicator="found")
    inside = both["found"].to_numpy() == "both"
    only_low, only_high = both["found"].to_numpy() == "left_only", both["found"].to_numpy() == "right_only"
    lo = np.where(only_high, both["first_high"], both["at"]).astype(np.int64)
    hi = np.where(only_low, both["last"], both["at_high"]).astype(np.int64)
    hi = np.maximum(lo, hi)

    sums = np.append(0, np.cumsum(np.where(known, value, 0).astype(np.longdouble)))
    counts = np.append(0, np.cumsum(known))
    n = counts[hi] - counts[lo]
    total = np.where(n > 0, (sums[hi] - sums[lo]).astype(float), np.nan)
    least = _extreme(_sparse(np.where(known, value, np.inf), np.minimum), lo, hi, np.minimum)
    most = _extreme(_sparse(np.where(known, value, -np.inf), np.maximum), lo, hi, np.maximum)
    anchor = np.where(only_high, both["place_high"], both["place"]).astype(np.int64)
    out = pd.DataFrame({
        "id": both["id"], "kind": np.where(inside, 0, np.where(only_low, -1, 1)), "n_rows": hi - lo, "n": n, "total": total,
        "least": np.where(n > 0, least, np.nan), "most": np.where(n > 0, most, np.nan)})
    return pd.concat([pdf[list(keys)].iloc[anchor].reset_index(drop=True), out], axis=1)


def range_frames(
    df: DataFrame, keys: Sequence[str], order: str, value: str, id_column: str, before: int, after: int = 0, pieces: int | None = None
) -> DataFrame:
    """``id_column, n_rows, n, total, least, most`` of each row's frame: the rows of its key whose whole number ``order`` is at most ``before`` smaller and
    ``after`` larger; ``n`` counts the values that are neither null nor NaN, over which sum and extremes go (null without any). ``id_column`` tells
    rows apart and is not null; null keys form a group; a row whose ``order`` is null has no row in the result, and is in no frame."""
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    by = list(names.values())
    rows = df.where(F.col(order).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in names.items()], F.col(order).cast("bigint").alias("at"), F.col(value).cast("double").alias("value"), F.col(id_column).alias("id"))
    bound = lambda side, shift: rows.select(*by, (F.col("at") + shift).alias("at"), F.lit(None).cast("double").alias("value"), "id", F.lit(side).alias("side"))
    points = rows.withColumn("side", F.lit(0)).unionByName(bound(-1, -before)).unionByName(bound(1, after))
    laid = in_pieces(points, by, ["at", "side", "id"], pieces)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        return _answered(pdf, by).assign(piece=int(pdf[PIECE].iloc[0]))

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in by), f"id {kinds['id']}", "kind int, n_rows bigint", _FACTS, "piece int"])
    told = write_table(laid.groupBy(PIECE).applyInPandas(answer, schema), "frames")
    sums, ends_of = ["n_rows", "n", "total"], {"least": F.min, "most": F.max}
    facts = [*[F.sum(c).alias(c) for c in sums], *[f(c).alias(c) for c, f in ends_of.items()]]
    whole = told.where("kind = 0").select("id", *sums, *ends_of)

    spans = told.where("kind <> 0").groupBy("id", *by).agg(
        F.max(F.when(F.col("kind") < 0, F.col("piece"))).alias("p"), F.max(F.when(F.col("kind") > 0, F.col("piece"))).alias("q"), *facts)
    held = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    totals = laid.where("side = 0").groupBy(*by, F.col(PIECE).alias("piece")).agg(
        F.count("*").alias("n_rows"), F.count(held).alias("n"), F.sum(held).alias("total"), F.min(held).alias("least"), F.max(held).alias("most"))
    between = spans.where("q > p + 1").select(*by, "p", "q").distinct()
    inner = null_safe_join(between, totals, by) if by else between.join(totals)
    inner = inner.where("piece > p and piece < q").groupBy(*by, "p", "q").agg(*facts)
    inner = write_table(inner.withColumnsRenamed({c: f"__{c}" for c in [*sums, *ends_of]}), "between")
    joined = null_safe_join(spans, F.broadcast(inner), [*by, "p", "q"], "left")  # at most two rows for each piece
    add = lambda c: F.coalesce(F.col(c) + F.col(f"__{c}"), F.col(c), F.col(f"__{c}")).alias(c)
    split = joined.select("id", *map(add, sums), F.least("least", "__least").alias("least"), F.greatest("most", "__most").alias("most"))
    return whole.unionByName(split).withColumnRenamed("id", id_column)


#: Rows of a key whose running quantiles one task finds on its own.
KEY_ROWS = 50_000


def _running(held: list[pa.RecordBatch], probs: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Whole keys, rows in order. Rows that are equal in the order share the largest of what they find, as in the descent."""
    t = pa.Table.from_batches(held)
    nth, rank = (t[c].to_numpy() for c in ("__nth", "__rank"))
    group = np.cumsum(nth == 1)
    v = pd.Series(t["__v"].to_numpy())
    known = v.notna().to_numpy()
    running = v[known].reset_index(drop=True).groupby(group[known], sort=False).expanding()

    def spread(found: np.ndarray) -> pd.Series:
        column = np.full(len(v), np.nan)
        column[known] = found
        return pd.Series(column).groupby(group, sort=False).ffill()

    out, tied = t.drop_columns(["__nth", "__rank", "__v"]), (nth != rank).any()
    for name, p in probs.items():
        if tied:
            low, high = (spread(running.quantile(p, interpolation=i).to_numpy()) for i in ("lower", "higher"))
            n = spread(running.count().to_numpy())
            low, high, n = (x.groupby([group, rank]).transform("max") for x in (low, high, n))
            at = p * (n - 1)
            found = low + (high - low) * (at - np.floor(at))
        else:
            found = spread(running.quantile(p).to_numpy())
        out = out.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
    yield from out.combine_chunks().to_batches()


def expanding_quantiles(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, probs: dict[str, float], pieces: int | None = None, key_rows: int = KEY_ROWS
) -> DataFrame:
    """``df`` with one column for each entry of ``probs``: the quantile, with linear interpolation, of the values of a key from its first row along ``order`` up
    to the current one. Null values count neither as rows nor as values, and bring the quantile of the rows before them; ``order`` tells the rows of a
    key apart.

    Keys of at most ``key_rows`` rows move once, and a task holds one key and a batch of rows. Rows of other keys are ranked and descended, and so are keys
    with a value that is not finite, which pandas takes for a missing one."""
    v = F.col(value).cast("double")
    odd = F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
    sizes = write_table(df.groupBy(*keys).agg(F.count("*").alias("__rows"), F.max(odd).alias("__odd")), "key-sizes")
    small = (F.col("__rows") <= key_rows) & ~F.col("__odd")
    n_small, n_large = sizes.agg(F.count(F.when(small, 1)), F.count(F.when(~small, 1))).first()
    if not (keys and n_small):
        return _descended(df, keys, order, value, probs, pieces)
    of = lambda chosen: null_safe_join(df, sizes.where(chosen).select(*keys), keys, "left_semi")
    along = Window.partitionBy(*keys).orderBy(*order)
    rows = (of(small) if n_large else df).select("*", v.alias("__v"), F.row_number().over(along).alias("__nth"), F.rank().over(along).alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            begins = np.flatnonzero(b.column("__nth").to_numpy() == 1)
            if len(begins):
                held.append(b.slice(0, int(begins[-1])))
                if any(h.num_rows for h in held):
                    yield from _running(held, probs)
                held = []
                b = b.slice(int(begins[-1]))
            held.append(b)
        if any(h.num_rows for h in held):
            yield from _running(held, probs)

    done = rows.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in probs)]))
    return done.unionByName(_descended(of(~small), keys, order, value, probs, pieces)) if n_large else done


def _descended(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, probs: dict[str, float], pieces: int | None) -> DataFrame:
    """The same for keys of any size, by a descent over the bits of the ranks."""
    told = df.withColumn("__known", F.col(value).isNotNull().cast("int"))
    told = write_table(prefix(told, keys, order, {"__n": ("sum", "__known")}, pieces), "expanding")
    known = told.where("__known = 1").select(*keys, *order, F.col(value).cast("double").alias("__v"), F.col("__n").alias("__pos"))
    ranked = write_table(positions(known, keys, ["__v", "__pos"], "__rank", pieces).withColumn("__rank", F.col("__rank") - 1), "ranked")
    most = ranked.agg(F.max("__rank")).first()[0]
    bits = max(1, int(most).bit_length()) if most is not None else 1

    # a question for each row and each of the two values that a quantile lies between
    wanted, names = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("__n") - 1)
        wanted += [F.struct(F.lit(f"lo_{name}").alias("w"), F.floor(at).alias("k")), F.struct(F.lit(f"hi_{name}").alias("w"), F.ceil(at).alias("k"))]
        names.append(name)
    asked = told.where("__n > 0").select(*keys, *order, F.col("__n").alias("__pos"), F.explode(F.array(*wanted)).alias("q"))
    asked = asked.select(*keys, *order, "__pos", F.col("q.w").alias("__w"), F.col("q.k").alias("__k"), F.lit(0).cast("bigint").alias("__code"))
    for bit in reversed(range(bits)):
        # rows whose rank begins with the code and goes on with 0, counted up to each question's position
        zeros = ranked.where((F.shiftright("__rank", bit) % 2) == 0).select(
            *keys, F.shiftright("__rank", bit + 1).alias("__code"), "__pos", F.lit(0).alias("__ask"), F.lit(1).alias("__one"))
        points = asked.withColumn("__ask", F.lit(1)).withColumn("__one", F.lit(0))
        both = points.unionByName(zeros, allowMissingColumns=True)
        counted = prefix(both, [*keys, "__code"], ["__pos", "__ask"], {"__before": ("sum", "__one")}, pieces).where("__ask = 1")
        left = F.col("__k") < F.col("__before")
        asked = write_table(counted.select(
            *keys, *order, "__pos", "__w", F.when(left, F.col("__k")).otherwise(F.col("__k") - F.col("__before")).alias("__k"),
            F.when(left, F.col("__code") * 2).otherwise(F.col("__code") * 2 + 1).alias("__code")), "descent")
    # many rows may have one value as their quantile, so it is carried to them in the order of ranks
    values = ranked.select(*keys, F.col("__rank").alias("__code"), "__v", F.lit(0).alias("__ask"), F.lit(0).cast("bigint").alias("__pos"))
    both = asked.drop("__k").withColumn("__ask", F.lit(1)).unionByName(values, allowMissingColumns=True)
    found = prefix(both, keys, ["__code", "__ask", "__pos"], {"__value": ("last", "__v")}, pieces).where("__ask = 1").withColumnRenamed("__value", "__found")
    wide = found.groupBy(*keys, *order).agg(
        F.max("__pos").alias("__pos"), *[F.max(F.when(F.col("__w") == f"{s}_{n}", F.col("__found"))).alias(f"__{s}_{n}") for n in names for s in ("lo", "hi")])
    outs = []
    for n in names:
        at = F.lit(float(probs[n])) * (F.col("__pos") - 1)
        outs.append((F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * (at - F.floor(at))).alias(n))
    return null_safe_join(told.select(*df.columns), wide.select(*keys, *order, *outs), [*keys, *order], "left")


def _in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, block: int):
    placed = positions(df, keys, order, "__pos")
    laid = with_halo(placed, F.col("__pos"), before=rows - 1, after=0, block=block)
    return laid, Window.partitionBy(*keys, "__block").orderBy("__pos").rowsBetween(1 - rows, 0)


def rolling_quantiles(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int, probs: dict[str, float], least: int | None = None, block: int = 1_000_000
) -> DataFrame:
    """``df`` with one column for each entry of ``probs``: the quantile, with linear interpolation, of the last ``rows`` rows of the key, this one included. Null
    values do not count; with fewer than ``least`` values (``rows`` if not given) it is null."""
    laid, w = _in_blocks(df, keys, order, rows, block)
    enough = F.count(value).over(w) >= (rows if least is None else least)
    outs = [F.when(enough, F.percentile(value, p).over(w)).alias(name) for name, p in probs.items()]
    return drop_halo(laid.select(*df.columns, "__home", "__block", *outs))


def rolling_moments(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int, block: int = 1_000_000) -> DataFrame:
    """``df`` with ``skew`` and ``kurt`` (excess) of the last ``rows`` rows of the key, both corrected for the size of the sample. Null values do not count. Null
    with fewer than three and four values, and where all values are equal."""
    laid, w = _in_blocks(df, keys, order, rows, block)
    n = F.count(value).over(w).cast("double")
    spread = F.max(value).over(w) > F.min(value).over(w)
    skew = F.skewness(value).over(w) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value).over(w) + 6)
    outs = [F.when(spread & (n >= 3), skew).alias("skew"), F.when(spread & (n >= 4), kurt).alias("kurt")]
    return drop_halo(laid.select(*df.columns, "__home", "__block", *outs))
