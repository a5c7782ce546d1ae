"""Joins on intervals of any width, with copies bounded by a logarithm.

The whole numbers are the leaves of a binary tree: node ``i`` of level ``v`` holds those from ``i * 2**v`` to before ``(i + 1) * 2**v``. A range is the
union of at most two nodes of each level, so it is repeated at most ``2 * log2(width) + 2`` times however wide it is, and a point lies in one
node of each level on which a range has one, 63 at most. A point and a range meet in exactly one node if the point lies in the range, else in none:
the join is one on equal nodes, without candidates to be dropped and without pairs met twice.

A node with more than a bounded share of the copies of a side is cut by a hash of the row, and the other side's copies in that node go
to each cut, so neither many points under one wide range nor many ranges over one point meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.skew import micros, positions
from larkspan.registry import query
from larkspan.session import write_table
from larkspan.sources.tables import table

LEVEL, NODE, ROW = "__level", "__node", "__row"

#: Struct (level, node) of each node of the range from __low to before __high: the left and the right rest of each level.
_COVER = """explode(flatten(transform(sequence(0, cast(floor(log2(__high - __low)) as int)), v -> filter(array(
    named_struct('level', v, 'node', shiftright(__low - 1, v) + 1, 'own', (shiftright(__low - 1, v) + 1) & 1 = 1 and shiftright(__low - 1, v) + 1 < shiftright(__high, v)),
    named_struct('level', v, 'node', shiftright(__high, v) - 1, 'own', shiftright(__high, v) & 1 = 1 and shiftright(__low - 1, v) + 1 < shiftright(__high, v))
  ), n -> n.own))))"""


def _known(by: Sequence[str], *more: Column) -> Column:
    return reduce(lambda x, y: x & y, [*[F.col(c).isNotNull() for c in by], *more])


def _range_nodes(ranges: DataFrame, low: Column, high: Column, by: Sequence[str]) -> DataFrame:
    bounded = ranges.withColumns({"__low": low.cast("bigint"), "__high": high.cast("bigint")}).where(_known(by, F.col("__low") < F.col("__high")))
    return bounded.withColumns({ROW: F.monotonically_increasing_id(), "__n": F.expr(_COVER)}).select(
        *ranges.columns, ROW, F.col("__n.level").alias(LEVEL), F.col("__n.node").alias(NODE))


def _point_nodes(points: DataFrame, levels: list) -> DataFrame:
    """A copy of each point for each level with ranges, unless it lies left or right of all of them."""
    at = [(r[LEVEL], r["first"], r["last"], F.shiftright("__at", r[LEVEL])) for r in levels]
    places = F.array(*[F.when(n.between(first, last), F.struct(F.lit(v).alias("level"), n.alias("node"))) for v, first, last, n in at])
    return points.withColumn("__n", F.explode(F.array_compact(places))).select(
        *[c for c in points.columns if c != "__at"], F.col("__n.level").alias(LEVEL), F.col("__n.node").alias(NODE))


def _heavy(side: DataFrame, node: Sequence[str], share: int, out: str) -> DataFrame:
    """Nodes with more than a ``share``-th of the copies of a side, so fewer than ``share`` rows, with the number of cuts."""
    sizes = write_table(side.groupBy(*node).agg(F.count("*").alias("n")), "nodes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(1, -(-total // share))
    return sizes.where(F.col("n") > limit).select(*node, F.ceil(F.col("n") / limit).cast("int").alias(out))


def interval_join(points: DataFrame, ranges: DataFrame, at: Column, low: Column, high: Column, by: Sequence[str] = (), share: int | None = None) -> DataFrame:
    """Inner join on ``low <= at < high`` and equal ``by``: the columns ``by``, the others of ``points``, the others of ``ranges``.

    ``at``, ``low`` and ``high`` are whole numbers between -2**62 and 2**62. Rows with a null among them or among ``by``, and empty ranges, join with nothing;
    equal rows each count. Columns other than ``by`` must differ between the sides. ``share`` is the number of equal parts that cuts are sized
    for, by default four for each shuffle partition.
    """
    by = list(by)
    own = [c for c in points.columns if c not in by]
    others = [c for c in ranges.columns if c not in by]
    clash = sorted(set(own) & set(others))
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    share = share or 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # row ids are written before they are read, so a task that runs again deals its rows as before
    placed = write_table(_range_nodes(ranges, low, high, by), "ranges")
    levels = placed.groupBy(LEVEL).agg(F.min(NODE).alias("first"), F.max(NODE).alias("last")).collect()  # 63 rows at most
    if not levels:
        return points.join(ranges.limit(0), by) if by else points.limit(0).join(ranges.limit(0), F.lit(True))
    met = write_table(points.withColumn("__at", at.cast("bigint")).where(_known(by, F.col("__at").isNotNull())).withColumn(ROW, F.monotonically_increasing_id()), "points")
    met = _point_nodes(met, levels)

    node = [*by, LEVEL, NODE]
    cuts = F.broadcast(_heavy(met, node, share, "__p").join(_heavy(placed, node, share, "__r"), node, "full"))  # fewer than 2 * share rows
    n = lambda c: F.coalesce(F.col(c), F.lit(1))
    deal = lambda c: F.pmod(F.xxhash64(ROW), n(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), n(c) - 1))
    left = met.join(cuts, node, "left").withColumn("__i", deal("__p")).withColumn("__j", each("__r")).select(*node, "__i", "__j", *own)
    right = placed.join(cuts, node, "left").withColumn("__j", deal("__r")).withColumn("__i", each("__p")).select(*node, "__i", "__j", *others)
    # merged, not broadcast: the written copies of a range are much smaller than its rows, so their size says little about the memory they take
    return left.join(right.hint("merge"), [*node, "__i", "__j"]).select(*by, *own, *others)


def overlap_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], by: Sequence[str] = (), share: int | None = None) -> DataFrame:
    """Pairs of intervals, each from its first bound to before its second, that have a point in common, with equal ``by``.

    Two intervals overlap if the left one begins in the right one, or the right one begins in the left one after its begin: two joins of points
    with ranges, which share no pair. Bounds, nulls, empty intervals, equal rows and column names are as in ``interval_join``.
    """
    (low, high), (low_r, high_r) = left_bounds, right_bounds
    lefts, rights = left.where(F.col(low) < F.col(high)), right.where(F.col(low_r) < F.col(high_r))
    first = interval_join(lefts, rights, F.col(low), F.col(low_r), F.col(high_r), by, share)
    second = interval_join(rights, lefts, F.col(low_r), F.col(low) + 1, F.col(high), by, share)
    return first.unionByName(second)


def _spans(spark: SparkSession, d: str, event_type: str, step: int, names: dict[str, str]) -> DataFrame:
    """From each event of a kind to the ``step``-th next of the same user: a lead by a join on the row number, so a busy user is no one task."""
    ev = table(spark, d, "events").where((F.col("event_type") == event_type) & F.col("user_id").isNotNull()).select("event_id", "user_id", micros("ts").alias("t"))
    laid = write_table(positions(ev, ["user_id"], ["t", "event_id"], "place"), "spans")
    ends = laid.select("user_id", (F.col("place") - step).alias("place"), F.col("t").alias("end"))
    return laid.join(ends, ["user_id", "place"]).select("user_id", F.col("event_id").alias(names["id"]), F.col("t").alias(names["low"]), F.col("end").alias(names["high"]))


@query(
    "join_range_any",
    """with b as (select event_id as purchase_id, user_id, ts as low, lead(ts, 3) over (partition by user_id order by ts, event_id) as high
         from events where event_type = 'purchase')
       select purchase_id, count(*) as n_views, round(sum(value), 2) as view_value
       from b join events v on v.user_id = b.user_id and v.event_type = 'view' and v.ts >= low and v.ts < high group by 1""",
)
def join_range_any(spark: SparkSession, d: str) -> DataFrame:
    """Views of a user between a purchase and the third next one: ranges from minutes to weeks, three over each point."""
    spans = _spans(spark, d, "purchase", 3, {"id": "purchase_id", "low": "low", "high": "high"})
    views = table(spark, d, "events").where("event_type = 'view'").select("user_id", micros("ts").alias("t"), "value")
    met = interval_join(views, spans, F.col("t"), F.col("low"), F.col("high"), ["user_id"])
    return met.groupBy("purchase_id").agg(F.count("*").alias("n_views"), F.round(F.sum("value"), 2).alias("view_value"))


@query(
    "join_overlap",
    """with b as (select event_id as purchase_id, user_id, epoch_us(ts) as low, epoch_us(lead(ts) over w) as high from events where event_type = 'purchase'
         window w as (partition by user_id order by ts, event_id)),
       c as (select event_id as click_id, user_id, epoch_us(ts) as low, epoch_us(lead(ts, 2) over w) as high from events where event_type = 'click'
         window w as (partition by user_id order by ts, event_id))
       select purchase_id, click_id, least(b.high, c.high) - greatest(b.low, c.low) as shared_us
       from b join c on b.user_id = c.user_id and b.low < c.high and c.low < b.high and b.low < b.high and c.low < c.high""",
)
def join_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Times between purchases against times of two clicks of the same user, each pair with the time it shares. At most three intervals
    cover a moment, so the pairs grow with the rows."""
    buys = _spans(spark, d, "purchase", 1, {"id": "purchase_id", "low": "low", "high": "high"})
    clicks = _spans(spark, d, "click", 2, {"id": "click_id", "low": "low_c", "high": "high_c"})
    shared = F.least("high", "high_c") - F.greatest("low", "low_c")
    return overlap_join(buys, clicks, ("low", "high"), ("low_c", "high_c"), ["user_id"]).select("purchase_id", "click_id", shared.alias("shared_us"))
