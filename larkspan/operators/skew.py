"""Building blocks that keep one hot key from landing in one task.

Ranks, running values and bounded frames are exact whatever the key distribution. Rows are laid out by range on the whole tuple of
keys and order columns, so a piece is bounded even when all rows belong to one key, whatever the types; every piece is
worked on alone, and small totals carry the state into the pieces where a key goes on. There is one plan for every size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.session import write_table

# Pieces of a range layout; None takes the session's number of shuffle partitions. Tests set it high.
PIECES: int | None = None
PIECE = "__piece"


def salts(df: DataFrame) -> int:
    """Cuts of a group: as many as the cluster's shuffle has partitions."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; the key columns are those of the left side."""
    if not on:
        return left.join(F.broadcast(right), how=how)  # one row: the totals of a table without keys
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same = reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[f"__r_{c}"]) for c in on])
    return left.join(right, same, how).drop(*[f"__r_{c}" for c in on])


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(c.cast("date")).cast("bigint")
    within = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1_000_000
    return day * 86_400_000_000 + within + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``df`` with ``__piece``: the range of (keys, order) a row lies in, ascending. Written once, so that all who read it see the same
    borders; rows that are equal in all these columns share a piece."""
    n = pieces or PIECES or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_table(df.repartitionByRange(n, *keys, *order).withColumn(PIECE, F.spark_partition_id()), "pieces")


_COMBINE = {
    # null when neither side has a value yet
    "sum": lambda before, here: F.coalesce(before + here, before, here),
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "product": lambda before, here: F.coalesce(before * here, before, here),
    "min": lambda before, here: F.least(before, here),
    "max": lambda before, here: F.greatest(before, here),
    "last": lambda before, here: F.coalesce(here, before),
}


def _window_agg(kind: str, column: str) -> Column:
    if kind == "last":
        return F.last(column, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "product": F.product, "min": F.min, "max": F.max}[kind](column)


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, str]],
    pieces: int | None = None,
) -> DataFrame:
    """Running aggregates per key along ``order`` (ascending, current row included).

    ``specs`` maps an output name to ``(kind, column)`` with kind one of sum, count,
    product, min, max, last (last non-null value, a forward fill). Null keys form a group.
    """
    laid = in_pieces(df, keys, order, pieces)
    upto = (
        Window.partitionBy(*keys, PIECE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = laid.select("*", *[_window_agg(k, c).over(upto).alias(o) for o, (k, c) in specs.items()])
    totals = []
    for out, (kind, col) in specs.items():
        if kind == "last":
            agg = F.max_by(col, F.when(F.col(col).isNotNull(), F.struct(*order)))
        else:
            agg = _window_agg(kind, col)
        totals.append(agg.alias(out))
    by_piece = Window.partitionBy(*keys).orderBy(PIECE)
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    # At a border between two pieces one key at most goes on, so this has fewer rows than there are pieces.
    carry = (
        laid.groupBy(*keys, PIECE)
        .agg(*totals)
        .select(
            *keys,
            PIECE,
            F.row_number().over(by_piece).alias("__nth"),
            *[_window_agg("sum" if k == "count" else k, o).over(before).alias(f"__before_{o}")
              for o, (k, _) in specs.items()],
        )
        .filter("__nth > 1")
    )
    joined = null_safe_join(here, F.broadcast(carry), [*keys, PIECE], "left")
    merged = [
        _COMBINE[kind](F.col(f"__before_{out}"), F.col(out)).alias(out)
        for out, (kind, _) in specs.items()
    ]
    return joined.select(*df.columns, *merged)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_pos", pieces: int | None = None
) -> DataFrame:
    """1-based row number per key; with no keys, a global row number."""
    return prefix(df.withColumn("__one", F.lit(1)), keys, order, {out: ("count", "__one")}, pieces).drop("__one")


def ranks(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], pieces: int | None = None) -> DataFrame:
    """row_number, rank, dense_rank, percent_rank, cume_dist and group size along ``value``.

    Ranks depend only on how many rows carry each value, so they come from value counts. Null keys form a group and null
    values come first, as in a window.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__ties"))
    run = prefix(
        counts.withColumn("__one", F.lit(1)),
        keys,
        [value],
        {"__upto": ("sum", "__ties"), "dense_rank": ("count", "__one")},
        pieces,
    )
    run = null_safe_join(run, df.groupBy(*keys).agg(F.count("*").alias("group_rows")), keys)
    run = run.select(
        *keys,
        value,
        (F.col("__upto") - F.col("__ties") + 1).alias("rank"),
        "dense_rank",
        "group_rows",
        (F.col("__upto") / F.col("group_rows")).alias("cume_dist"),
    )
    run = run.withColumn(
        "percent_rank",
        F.when(F.col("group_rows") == 1, F.lit(0.0)).otherwise((F.col("rank") - 1) / (F.col("group_rows") - 1)),
    )
    return null_safe_join(positions(df, keys, [value, *tie], "row_number", pieces), run, [*keys, value])


def ntile(position: Column, rows: Column, n: int) -> Column:
    """Tile of a row from its position and group size: the first ``rows % n`` tiles get one more."""
    small, extra = F.floor(rows / n), rows % n
    edge = extra * (small + 1)
    in_large = F.floor((position - 1) / (small + 1)) + 1
    in_small = extra + F.floor((position - 1 - edge) / F.greatest(small, F.lit(1))) + 1
    return F.when(position <= edge, in_large).otherwise(in_small).cast("int")


def with_halo(
    df: DataFrame, position: Column, before: int, after: int, block: int, keep_cols: Sequence[str] | None = None
) -> DataFrame:
    """Cut rows into blocks along ``position`` and copy the border rows into the neighbour
    block, so that a frame of ``before``/``after`` can be evaluated per (key, ``__block``).
    Rows with ``__home`` false are copies: drop them after the window.
    """
    first = F.floor((position - after) / block)
    last = F.floor((position + before) / block)
    cols = list(keep_cols or df.columns)
    return df.select(
        *cols, F.floor(position / block).alias("__own"), F.explode(F.sequence(first, last)).alias("__block")
    ).select(*cols, "__block", (F.col("__own") == F.col("__block")).alias("__home"))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("__home").drop("__home", "__block")


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], pieces: int | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of ``probs``.

    Value counts and running counts replace the per-group value map of ``percentile``,
    which would hold every distinct value of a hot group in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__ties"))
    run = prefix(counts, keys, [value], {"__upto": ("sum", "__ties")}, pieces)
    run = null_safe_join(run, run.groupBy(*keys).agg(F.sum("__ties").alias("__n")), keys)
    start, upto = F.col("__upto") - F.col("__ties"), F.col("__upto")
    aggs, outs = [], []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("__n") - 1)
        low, high = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((start <= low) & (low < upto), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when((start <= high) & (high < upto), F.col(value))).alias(f"__hi_{name}"),
            F.max(at - low).alias(f"__f_{name}"),
        ]
        outs.append(
            (F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * F.col(f"__f_{name}")).alias(name)
        )
    return run.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def blocks_of(df: DataFrame, keys: Sequence[str], spread: Sequence[str], rows: int) -> DataFrame:
    """Add ``__block`` so that each (key, block) holds about ``rows`` rows at most, even if one key had them all; for work
    that needs a whole block in memory. ``spread`` columns decide the block by hash."""
    blocks = max(1, math.ceil(df.count() / rows))
    return df.withColumn("__block", F.pmod(F.xxhash64(*spread), F.lit(blocks)))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], spread: Sequence[str], k: int, out: str = "place") -> DataFrame:
    """The first ``k`` rows of every group. Each group is cut by the hash of ``spread`` and
    only the best ``k`` rows of a cut go on to the final ranking."""
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts(df))))
        .withColumn(out, F.row_number().over(local)).filter(F.col(out) <= k).drop("__salt")
        .withColumn(out, F.row_number().over(final)).filter(F.col(out) <= k)
    )
