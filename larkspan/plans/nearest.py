"""The largest inner products of each user with all items, exactly, without a product of the two tables.

Items are laid out by falling norm in blocks. By Cauchy and Schwarz a score is at most the user's norm times the norm of the item, so once
a user's k-th best score exceeds that bound for the first norm of a block, no later block can change the result. Rounds take 1, 2, 4, ... blocks, so
there are as many as the logarithm of the number of blocks, and only users that are still open go into a round; within it each
block is bounded again. A task multiplies one chunk of users with one block of items, both of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.operators.skew import positions, top_per_group
from larkspan.session import write_table

BLOCK_ROWS = 2_048
CHUNK_ROWS = 8_192
#: Products and norms are rounded, each by less than this share of the bound.
SLACK = 1 + 1e-9


def _usable(df: DataFrame, key: str) -> DataFrame:
    finite = F.coalesce(F.forall("f", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x))
    return df.select(key, F.col("f").cast("array<double>")).where(finite).withColumn("norm", norm)


def _reaches(norm: Column | float, length: Column, best: Column) -> Column:
    return best.isNull() | (F.lit(norm) * length * SLACK >= best)


def _products(k: int, user_type: str, item_type: str):
    def multiply(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        bound = users["length"].to_numpy() * items["norm"].max() * SLACK if len(items) else np.empty(0)
        users = users[users["best"].isna().to_numpy() | (bound >= users["best"].to_numpy(float))] if len(items) else users[:0]
        if users.empty:
            return pd.DataFrame({"user": users["user"], "item": items["item"][:0], "score": pd.Series(dtype=float), "visit": pd.Series(dtype="int32")})
        items = items.sort_values("item")
        scores = np.stack(users["f"]) @ np.stack(items["f"]).T
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # equal scores in the order of the items
        n = top.shape[1]
        return pd.DataFrame({
            "user": np.repeat(users["user"].to_numpy(), n), "item": items["item"].to_numpy()[top.ravel()],
            "score": np.take_along_axis(scores, top, axis=1).ravel(), "visit": np.tile((np.arange(n) == 0).astype(np.int32), len(users))})

    return multiply, f"user {user_type}, item {item_type}, score double, visit int"


def top_inner_products(users: DataFrame, items: DataFrame, k: int, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``user, place, item, score, visited, blocks``: the ``k`` items with the largest inner product for each user, equal scores by item, and how many of
    the blocks the user's vector was multiplied with.

    ``users`` has ``user`` and ``f``, ``items`` has ``item`` and ``f``; ids are unique, vectors of one length. Vectors that are null or hold a null, NaN or infinite
    component take no part. With fewer than ``k`` items a user gets all of them; without items, no row.
    """
    laid = positions(_usable(items, "item").withColumn("__falling", -F.col("norm")), [], ["__falling", "item"], "pos").drop("__falling")
    laid = write_table(laid.withColumn("block", F.floor((F.col("pos") - 1) / block_rows)).drop("pos"), "items")
    people = write_table(_usable(users, "user").withColumnRenamed("norm", "length"), "users")
    kinds = {f.name: f.dataType.simpleString() for f in (*people.schema, *laid.schema)}
    multiply, schema = _products(k, kinds["user"], kinds["item"])
    blocks = math.ceil(laid.count() / block_rows)
    best = people.sparkSession.createDataFrame([], schema).drop("visit")
    rounds, low, width = [best.select("user", F.lit(0).alias("visit"))], 0, 1
    while low < blocks:
        high = min(blocks, low + width)
        largest = laid.where(F.col("block") == low).agg(F.max("norm")).first()[0]
        kth = best.groupBy("user").agg(F.when(F.count("*") >= k, F.min("score")).alias("best"))
        open_ = write_table(people.join(kth, "user", "left").where(_reaches(largest, F.col("length"), F.col("best"))), "open")
        n = open_.count()
        if n == 0:
            break
        chunks = math.ceil(n / chunk_rows)
        left = open_.withColumn("chunk", F.pmod(F.xxhash64("user"), F.lit(chunks)).cast("bigint")).withColumn("block", F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint"))))
        right = laid.where(F.col("block").between(low, high - 1)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
        found = write_table(left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(multiply, schema), "found")
        rounds.append(found.where("visit = 1").groupBy("user").agg(F.count("*").alias("visit")))
        both = best.unionByName(found.drop("visit"))
        best = write_table(top_per_group(both, ["user"], [F.desc("score"), F.asc("item")], ["item"], k).drop("place"), "best")
        low, width = high, width * 2
    visits = rounds[0]
    for r in rounds[1:]:
        visits = visits.unionByName(r)
    visits = visits.groupBy("user").agg(F.sum("visit").alias("visited"))
    # ranked last, so that a user's rows come by place
    ranked = top_per_group(best.join(visits, "user"), ["user"], [F.desc("score"), F.asc("item")], ["item"], k)
    return ranked.select("user", "place", "item", "score", "visited", F.lit(blocks).cast("bigint").alias("blocks"))
