"""What the trained operators share: which labels they may learn from, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Every fifth row by the checksum of its id; a row without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, column: str, max_train: int) -> DataFrame:
    """doc_id and y of at most ``max_train`` labelled documents that are not held out, those with the smallest hash of their id.
    Several labels of a document count as their largest; null ids and null labels do not count."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
