"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches. The keys seen so far live in sorted runs: bucketed tables, disjoint in their keys.
A new batch is grouped to its keys, merge-anti-joins every run, and what is left, its fresh keys, becomes a
run of level 0; keys met before only leave a tally. When a level holds ``fan_in`` runs they are compacted into one run
of the next level. Runs and batch are bucketed and sorted alike, so only the batch is shuffled.

Defined cases: a null or empty text is one empty line; a line's key is the line without ``[\\x20\\x09-\\x0D]`` at both
ends, with A-Z in lower case; each row is a document, and rows with the same doc_id count once for a key; a null doc_id
is smaller than any other; rows that share the largest doc_id of a key all keep it; an empty table gives no rows; further
columns pass through ``drop_repeated_lines`` unless they have the name of one of its own results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.session import scratch_path, write_table

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
SMALLEST = -(2**63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that counts: d and t (the document and the hash of its text, which tells rows that share
    a doc_id apart), pos (of the line), h1 and h2 (128 bits of its key)."""
    lines = docs.select(
        F.coalesce("doc_id", F.lit(SMALLEST)).alias("d"),
        F.xxhash64("text").alias("t"),
        F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)).alias("pos", "key"),
    )
    return lines.where(F.length("key") >= min_chars).select(
        "d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")
    )


class Runs:
    """The levels of sorted runs. Every run is a bucketed table in the shared folder."""

    def __init__(self, spark, fan_in: int = 2):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = keys.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", scratch_path(self.spark, "line-run")).saveAsTable(name)
        return name

    def add(self, name: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for other in old[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self.add(self.write(merged), level + 1)
            self.forget(old)

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")


def line_totals(rows: DataFrame, batches: int, fan_in: int) -> DataFrame:
    """h1, h2, n_docs, last_doc for every key, gathered batch by batch; rows with equal d are in one batch."""
    spark = rows.sparkSession
    runs = Runs(spark, fan_in)
    tallies = []
    for b in range(batches):
        part = rows.where(F.pmod(F.xxhash64("d"), F.lit(batches)) == b)
        own = runs.write(part.groupBy(*KEY).agg(F.countDistinct("d").alias("n_docs"), F.max("d").alias("last_doc")))
        seen = runs.names()
        if not seen:
            runs.add(own)
            continue
        fresh = spark.table(own)
        for run in seen:
            fresh = fresh.join(spark.table(run), KEY, "left_anti")
        fresh_name = runs.write(fresh)
        tallies.append(write_table(spark.table(own).join(spark.table(fresh_name), KEY, "left_anti"), "line-tally"))
        runs.forget([own])
        runs.add(fresh_name)
    total = None
    for part in [spark.table(x) for x in runs.names()] + tallies:
        total = part if total is None else total.unionByName(part)
    out = write_table(total.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")), "line-totals")
    runs.forget(runs.names())
    return out


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 2
) -> DataFrame:
    """``docs`` with text replaced by the lines that stay, and n_lines, n_dropped.

    Keys of at least ``min_chars`` code points found in ``min_docs`` documents lose all their lines except in
    the largest doc_id holding it.
    """
    rows = write_table(line_rows(docs, min_chars), "lines")
    repeated = line_totals(rows, batches, fan_in).where(F.col("n_docs") >= min_docs)
    gone = (
        rows.join(repeated, KEY)
        .where(F.col("d") < F.col("last_doc"))
        .groupBy(F.col("d").alias("__d"), F.col("t").alias("__t"))
        .agg(F.collect_list("pos").alias("__gone"))
    )
    others = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped", "__d", "__t", "__gone", "__lines")]
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    text = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    plain = docs.select(*[c for c in docs.columns if c in others or c == "text"])
    same = (F.coalesce(plain["doc_id"], F.lit(SMALLEST)) == F.col("__d")) & (F.xxhash64(plain["text"]) == F.col("__t"))
    joined = plain.join(gone, same, "left").withColumn("__lines", lines)
    return joined.select(
        *others,
        F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(text).alias("text"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__lines") - F.size(kept), F.lit(0)).cast("bigint").alias("n_dropped"),
    ).select(*plain.columns, "n_lines", "n_dropped")
