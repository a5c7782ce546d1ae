"""Plans and building blocks: what reaches the scan, what never appears in a plan, how state merges."""

from __future__ import annotations

import io
import os
import pathlib
import subprocess
import sys
import tempfile
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from larkspan.plans.scoring import hash_tree
from larkspan.session import shared_root, spread
from larkspan.streaming.state import merge_sessions

Q = entry.queries()


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(Q["filter_range"](spark, sf_dir))
    assert "PushedFilters" in text and "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_quantity" in text
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "l_extendedprice" not in schema and "l_partkey" not in schema


@pytest.mark.parametrize("key", ["join_star", "agg_q1", "join_range", "join_interval", "kde", "agg_salted", "topk_group", "matmul"])
def test_no_product_of_tables(spark, sf_dir, key):
    text = plan(Q[key](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_bucketed_join_reads_without_shuffle(spark, sf_dir):
    text = plan(Q["bucketed_table"](spark, sf_dir))
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning(l_orderkey") == 0


def test_top_k_is_not_a_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(Q["topk"](spark, sf_dir))


def test_hash_tree_ignores_partitions_but_not_values(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    mark = lambda x: hash_tree(x, "id", F.col("v").cast("string")).first()["fingerprint"]
    assert mark(df.repartition(1)) == mark(df.repartition(13))
    assert mark(df) != mark(df.withColumn("v", F.when(F.col("id") == 4321, 9).otherwise(F.col("v"))))


def test_sessions_merge_in_any_order():
    parts = [[0, 2, 2, 1.0, False], [5, 6, 1, 1.0, False], [100, 100, 1, 1.0, False], [3, 4, 1, 1.0, False]]
    for order in (parts, parts[::-1]):
        assert [m[:3] for m in merge_sessions(order, 10)] == [[0, 6, 4], [100, 100, 1]]
    ended = merge_sessions([[0, 0, 1, 1.0, False], [1, 1, 1, 1.0, True], [2, 2, 1, 1.0, False]], 10)
    assert [m[:3] for m in ended] == [[0, 1, 2], [2, 2, 1]]


def test_empty_chunks_are_legal(spark):
    from larkspan.plans.training import softmax_gradient, train

    empty = spark.createDataFrame([], "id bigint, x array<double>, y int")
    assert train(empty, 4, softmax_gradient(2))[1] == []


def test_spread_leaves_wide_inputs_alone(spark):
    wide = spark.range(0, 1000, 1, 32)
    assert spread(wide) is wide
    assert spread(spark.range(0, 1000, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shared_root_is_stable(spark):
    assert shared_root(spark) == shared_root(spark)


def test_no_local_checkpoint_in_the_library():
    root = pathlib.Path(entry.__file__).parent / "larkspan"
    for f in root.rglob("*.py"):
        assert "localCheckpoint" not in f.read_text(), f


def test_nothing_is_left_after_a_run(spark, sf_dir):
    """In a session of its own Python process: no folder below the shared root, no table in the catalog."""
    code = f"""
import os, sys
sys.path.insert(0, {str(pathlib.Path(entry.__file__).parent)!r})
import __spark_entry__ as e
from larkspan.session import clean_up, local_session, shared_root
spark = local_session(2, spark__checkpoint__dir=sys.argv[1])
for key in ("bucketed_table", "train_softmax", "gram_matrix", "stream_state_session"):
    e.queries()[key](spark, {sf_dir!r}).collect()
own = lambda: [f for f in os.listdir(sys.argv[1]) if f.startswith("larkspan")]  # Spark makes a folder of its own there
assert own()
clean_up(spark)
left = [t.name for t in spark.catalog.listTables() if not t.isTemporary]
print("LEFT", own(), left)
"""
    with tempfile.TemporaryDirectory() as shared, tempfile.TemporaryDirectory() as elsewhere:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", code, shared], cwd=elsewhere, env=env, capture_output=True, text=True, timeout=300)
    assert "LEFT [] []" in done.stdout, done.stdout + done.stderr[-2000:]


def test_local_cluster_is_not_one_process():
    from types import SimpleNamespace as N

    from larkspan.session import _one_process

    assert all(_one_process(N(sparkContext=N(master=m))) for m in ("local", "local[4]", "local[*]"))
    assert not any(_one_process(N(sparkContext=N(master=m))) for m in ("local-cluster[2,1,900]", "spark://h:7077", "yarn"))


@pytest.mark.parametrize("key", ["join_nullsafe", "join_range"])
def test_facts_are_not_dealt_by_a_few_values(spark, sf_dir, key):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(Q[key](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    joins = [line for line in text.splitlines() if "hashpartitioning(" in line]
    # the join's own exchange names the cut beside the value
    assert any(("cut" in line or "__cut" in line) for line in joins), joins
