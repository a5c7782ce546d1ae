"""Exact similarity join of two tables of sets.

Two sets whose Jaccard similarity reaches a threshold have sizes that are not far apart, and share an element among the first few of each, if both are
written in one order of all elements. The order here is from rare to frequent, so few sets meet at a shared element; where it stands in both bounds what they
can have in common. Pairs that pass are compared in full. Any order gives the same result, so frequencies are counted by hash in a table of fixed size, and the
driver and the tasks hold no vocabulary.

Equal sets are one class from the start: copies meet nothing twice, and the join pairs classes. An element in many sets is cut on
both sides by its count, so a meeting has a bounded number of rows from each side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.registry import query
from larkspan.session import write_table
from larkspan.sources.tables import table

#: Cells of the table of frequencies: 2 MB a side.
CELLS = 1 << 18
#: Sets of one side that meet at one element in one place.
MEETING = 4_096
#: Elements a task sends on at a time, about.
SENT = 100_000


def _cell(h: Column) -> Column:
    return F.pmod(h, F.lit(CELLS))


def classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, class`` of each row of ``id, set`` whose set has an element, and ``class, set, h`` of each distinct set, with the hashes of its elements."""
    # null elements go; the class is a digest of the sorted elements, each in quotes
    rows = df.select("id", F.array_sort(F.array_distinct(F.array_compact("set"))).alias("set")).where(F.size("set") > 0)
    rows = write_table(rows.withColumn("class", F.unhex(F.sha2(F.to_json("set"), 256))), "sets")
    distinct = rows.dropDuplicates(["class"]).select("class", "set", F.transform("set", lambda x: F.xxhash64(x)).alias("h"))
    return rows.select("id", "class"), write_table(distinct, "classes")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets have an element of each cell; an element has at most its cell's count."""
    counts = sets.select(F.explode("h").alias("h")).groupBy(_cell(F.col("h")).alias("cell")).count().toPandas()
    out = np.zeros(CELLS, dtype=np.int64)
    out[counts["cell"].to_numpy(dtype=np.int64)] = counts["count"].to_numpy()
    return out


def prefixes(sets: DataFrame, percent: int, rarity: np.ndarray, own: np.ndarray, other: np.ndarray, name: str) -> DataFrame:
    """The first elements of each class with their places, in the cuts where they meet those of the other side: ``{name}_class, {name}_n, {name}_at, h, cut_{name},
    cut_{other}``. ``own`` and ``other`` are the frequencies of the two sides."""

    columns = ("n", "at", "h", "own", "others")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keys, out, waiting = [], [], 0
            for key, h in zip(rows["class"], rows["h"]):
                h = np.asarray(h, dtype=np.int64)
                n = len(h)
                h = h[np.lexsort((h, rarity[h % CELLS]))][: n + 1 - -(-percent * n // 100)]
                at = np.flatnonzero(other[h % CELLS])  # an element whose cell is empty on the other side meets nothing; it keeps its place
                h = h[at]
                pieces = -(-own[h % CELLS] // MEETING)
                keys += [key] * len(h)  # a list: numpy's byte strings lose zeros at their end
                out.append((np.full(len(h), n), at, h, int.from_bytes(key[:6], "big") % np.maximum(pieces, 1), np.maximum(-(-other[h % CELLS] // MEETING), 1)))
                waiting += len(h)
                if waiting >= SENT:
                    yield pd.DataFrame({"class": keys} | dict(zip(columns, map(np.concatenate, zip(*out)))))
                    keys, out, waiting = [], [], 0
            if out:
                yield pd.DataFrame({"class": keys} | dict(zip(columns, map(np.concatenate, zip(*out)))))

    found = sets.select("class", "h").mapInPandas(first, "class binary, n int, at int, h bigint, own bigint, others bigint")
    return found.select(
        F.col("class").alias(f"{name}_class"), F.col("n").alias(f"{name}_n"), F.col("at").alias(f"{name}_at"), "h", F.col("own").alias(f"cut_{name}"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)).alias("cut_other"))


def similar_sets(left: DataFrame, right: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pairs of a left and a right set with ``100 * common >= percent * union``, all of them: ``left_class, right_class, common, left_n, right_n``; then ``id, class``
    of the left and of the right rows; then the pairs that were compared in full, ``left_class, right_class``.

    Both tables have ``id`` and ``set``, an array of strings; ``percent`` is 1 to 100. Repeated and null elements do not count; a set that is null or has no element
    is in no class and no pair. Repeated ids stay repeated in the membership. An empty table gives no pair.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    (left_ids, left_sets), (right_ids, right_sets) = classes(left), classes(right)
    ours, theirs = frequencies(left_sets), frequencies(right_sets)
    a = prefixes(left_sets, percent, ours + theirs, ours, theirs, "left").withColumnRenamed("cut_other", "cut_right")
    b = prefixes(right_sets, percent, ours + theirs, theirs, ours, "right").withColumnRenamed("cut_other", "cut_left")
    n, m = F.col("left_n"), F.col("right_n")
    before = F.least("left_at", "right_at")
    after = F.least(n - F.col("left_at"), m - F.col("right_at"))
    near = a.join(b, ["h", "cut_left", "cut_right"]).where((100 * n >= percent * m) & (100 * m >= percent * n) & ((100 + percent) * (before + after) >= percent * (n + m)))
    candidates = write_table(near.select("left_class", "right_class").distinct(), "candidates")
    both = candidates.join(left_sets.select(F.col("class").alias("left_class"), F.col("set").alias("l")), "left_class")
    both = both.join(right_sets.select(F.col("class").alias("right_class"), F.col("set").alias("r")), "right_class")
    counted = both.select("left_class", "right_class", F.size(F.array_intersect("l", "r")).alias("common"), F.size("l").alias("left_n"), F.size("r").alias("right_n"))
    pairs = counted.where(100 * F.col("common") >= percent * (F.col("left_n") + F.col("right_n") - F.col("common")))
    return pairs, left_ids, right_ids, candidates


ITEM_PERCENT = 20
_WORDS = "list_distinct(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> ''))"


def word_sets(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != "").alias("set"))


@query(
    "similar_items",
    f"""with i as (select item_id, {_WORDS} as s from benchmark), e as (select doc_id, {_WORDS} as s from documents),
      p as (select item_id, doc_id, count(*) as common from (select item_id, unnest(s) as w from i) join (select doc_id, unnest(s) as w from e) using (w) group by all)
      select item_id, doc_id, common, len(i.s) as item_words, len(e.s) as doc_words from p join i using (item_id) join e using (doc_id)
      where 100 * common >= {ITEM_PERCENT} * (len(i.s) + len(e.s) - common)""",
)
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items and documents with similar sets of words, exactly. Classes of equal sets are joined; each copy of a text adds one row for its items."""
    items, docs = word_sets(table(spark, d, "benchmark"), "item_id"), word_sets(table(spark, d, "documents"), "doc_id")
    pairs, item_ids, doc_ids, _ = similar_sets(items, docs, ITEM_PERCENT)
    named = pairs.join(item_ids.select(F.col("id").alias("item_id"), F.col("class").alias("left_class")), "left_class")
    named = named.join(doc_ids.select(F.col("id").alias("doc_id"), F.col("class").alias("right_class")), "right_class")
    return named.select("item_id", "doc_id", *[F.col(c).cast("bigint").alias(a) for c, a in (("common", "common"), ("left_n", "item_words"), ("right_n", "doc_words"))])
