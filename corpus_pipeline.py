"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

1. toxicity: documents with a score of 0.5 or more go; the model is trained on the labels of ``sf_dir``.
2. lines: lines of at least 20 characters found in three documents or more stay in the last of them only.
3. near_duplicates: one document of each group stays, the one with the smallest doc_id; similarity of 0.85 on five-word shingles.
4. benchmark: documents that hold ten consecutive words of a benchmark item go.
5. packing: what is left becomes pieces in sequences of at most 4096 tokens.

All but the last stage return the columns of documents; a changed text brings its new number of characters in n_chars. A null text
comes out of the second stage as an empty one. Rows that share a doc_id are one document to the third stage, which keeps
or drops them together; an empty table stays empty. Ties and texts of any length are as in the operators. Columns beyond those of documents stay
as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import bestfit_packing, decontaminate, line_dedup, minhash_dedup, queries, toxicity
from larkspan.session import ship, write_table
from larkspan.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    """``fn``, with the package on the workers before it runs."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


def with_own_columns(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)`` with the columns of ``docs``: those that no stage reads go through under names that no operator uses, so that a column of the
    user that is called as one of an operator's results keeps its values."""
    aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    done = work(docs.withColumnsRenamed(aside))
    return done.select(*[F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in docs.columns])


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return with_own_columns(docs, lambda rows: toxicity.score_toxicity(rows, model).where("score < 0.5"))


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return with_own_columns(docs, lambda rows: line_dedup.drop_repeated_lines(rows).withColumn("n_chars", n_chars))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told by doc_id; of rows with the same doc_id all stay or go, as they are one document."""
    gone = minhash_dedup.find_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return with_own_columns(docs, lambda rows: decontaminate.find_benchmark(rows, benchmark).where("n_hit = 0"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_contaminated),
    ("packing", pack),
]

#: Models, links and packing cannot be told in SQL; the tests hold the pipeline to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = write_table(fn(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
