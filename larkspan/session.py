"""Session creation and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Names of tables that jobs leave in the catalog until clean_up().
TABLE_PREFIX = "larkspan_"


def local_session(cpus: str | int = "*", app: str = "larkspan", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LARKSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; ``local-cluster`` is not."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_root(spark: SparkSession) -> str:
    """Folder of this run that every executor can reach.

    The cluster names its parent in ``spark.checkpoint.dir``. Only a local session, where driver
    and executors are one process, may fall back to a temporary folder, which goes when Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not _one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="larkspan-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/larkspan-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Remove what this run has written below the shared folder, and its tables in the catalog. Results that are not yet read need those
    files, so call it when all is done."""
    root = shared_root(spark)
    for t in spark.catalog.listTables():
        if t.name.startswith(TABLE_PREFIX) and not t.isTemporary:
            spark.sql(f"drop table if exists {t.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give this package to the workers, once a session: a cluster need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_larkspan_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="larkspan-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/larkspan.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(f"{folder}/larkspan.zip")
    context._larkspan_shipped = True


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of one job."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Spark cuts up the code of rows with many expressions. Past 8,000 bytes the JVM interprets a method for ever, and Spark's own limit is 65,535."""
    with setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000"):
        yield


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: a lineage cut that also
    keeps column statistics for later scans."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table that ``write_table`` wrote, once nobody reads them any more."""
    spark = df.sparkSession
    root = f"{shared_root(spark)}/".split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What a job has shuffled goes when the job ends. Else it stays on the executors' disks until the driver happens to collect garbage, and rounds pile it up."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def write_parts(df: DataFrame, held_out: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """``write_table`` in two parts, the rows that are not held out and those that are: neither scan reads the other's rows or asks again which they are."""
    path, spark = scratch_path(df.sparkSession, name), df.sparkSession
    rows = df.withColumn("held_out", held_out)
    rows.write.partitionBy("held_out").parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.filter(~F.col("held_out")).drop("held_out"), back.filter("held_out").drop("held_out")


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the input has fewer splits than there are cores: work that is heavy
    per row then uses all of them. Large inputs pass through without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
