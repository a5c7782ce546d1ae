"""Broken records: good plus bad rows are the input, whatever is broken; the three modes; records over several lines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspan.session import scratch_path
from larkspan.sources.broken import read_checked, read_lenient, read_strict

SCHEMA = "a bigint, b double, c string"


def file(spark, name, lines, parts=2):
    path = scratch_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(parts).write.text(path)
    return path


GOOD_CSV = ["1,2.5,x", "2,,y", '3,1e3,"q,r"', "4,0,"]
BAD_CSV = ["x,1,2", "1,2", "1,2,3,4", "9223372036854775808,1,z", "1,much,z"]


def test_csv_parts_are_the_input(spark):
    path = file(spark, "csv", [*GOOD_CSV, *BAD_CSV, *BAD_CSV[:1]])
    got = read_checked(spark, path, "csv", SCHEMA)
    assert sorted(r["a"] for r in got.good.collect()) == [1, 2, 3, 4] and got.good.columns == ["a", "b", "c"]
    assert sorted(r["record"] for r in got.bad.collect()) == sorted([*BAD_CSV, BAD_CSV[0]])
    assert all(path in r["file"] for r in got.bad.collect())
    # the parts answer alone and by one column, too, and the same again
    assert got.bad.count() == 6 and got.good.select("c").count() == 4 and got.bad.select("record").distinct().count() == 5


def test_required_and_shares(spark):
    path = file(spark, "csv", GOOD_CSV + BAD_CSV[:1])
    got = read_checked(spark, path, "csv", SCHEMA, required=["b", "c"])
    assert sorted(r["a"] for r in got.good.collect()) == [1, 3]
    assert {r["record"] for r in got.bad.collect()} == {"x,1,2", '{"a":2,"b":null,"c":"y"}', '{"a":4,"b":0.0,"c":null}'}
    assert got.accept(0.6).count() == 2
    with pytest.raises(ValueError, match="3 of 5"):
        got.accept(0.5)


def test_json_parts_are_the_input(spark):
    good = ['{"a":1,"b":2.5,"c":"x"}', '{"a":2}', '{"c":"more","z":1,"a":null}', '{"a":3,"c":"line\\nbreak \\u00e9"}']
    bad = ['{"a":1,"b":2.5', '{"a":"one"}', "no json", '{"a":1}}x{', '{"a":[1]}', '[{"a":"one"}]']
    got = read_checked(spark, file(spark, "json", good + bad), "json", SCHEMA)
    kept, left = got.good.collect(), sorted(r["record"] for r in got.bad.collect())
    # the parser takes what follows a whole record for the next line's business
    assert left == sorted(x for x in bad if x in left) and {bad[0], bad[1], bad[2], bad[4], bad[5]} <= set(left)
    assert len(kept) + len(left) == len(good) + len(bad)
    assert {(r["a"], r["c"]) for r in kept} >= {(1, "x"), (2, None), (None, "more"), (3, "line\nbreak é")}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_nothing_to_read(spark, fmt):
    for lines in ([], ["", ""]):
        got = read_checked(spark, file(spark, fmt, lines, 1), fmt, SCHEMA)
        assert got.good.count() == 0 and got.bad.count() == 0 and got.accept(0.0).columns == ["a", "b", "c"]


def test_strict_and_lenient(spark):
    path = file(spark, "csv", GOOD_CSV + BAD_CSV)
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        read_strict(spark, path, "csv", SCHEMA).select("*").collect()
    assert read_strict(spark, file(spark, "csv", GOOD_CSV), "csv", SCHEMA).count() == 4
    assert read_lenient(spark, path, "csv", SCHEMA).count() == 4
    assert read_lenient(spark, path, "csv", SCHEMA).select("c").count() == 4  # checked although not asked for


def test_records_over_several_lines(spark):
    path = scratch_path(spark, "lines")
    texts = ['two\nlines, "quoted"', "", " blanks kept ", "a;b\n\n\nc", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "a bigint, c string").withColumn("b", F.lit(1.5)).select("a", "b", "c")
    fmt = {"escape": '"', "quoteAll": True, "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.coalesce(1).write.options(**fmt).csv(path)
    spark.createDataFrame([('"5","word","x\ny"',)], "value string").coalesce(1).write.mode("append").text(path)
    got = read_checked(spark, path, "csv", SCHEMA, multiLine=True, **fmt)
    assert {r["a"]: r["c"] for r in got.good.collect()} == dict(enumerate(texts))
    bad = [r["record"] for r in got.bad.collect()]
    assert len(bad) == 1 and "word" in bad[0] and "x\ny" in bad[0]

    whole = scratch_path(spark, "arrays")
    spark.createDataFrame([('[\n{"a":1,\n"c":"x"},\n{"a":2}\n]',), ('{"a":3,\n"b"',)], "value string").write.option("maxRecordsPerFile", 1).text(whole)
    got = read_checked(spark, whole, "json", SCHEMA, multiLine=True)
    assert sorted(r["a"] for r in got.good.collect()) == [1, 2] and got.bad.count() == 1


def test_what_cannot_be_parted(spark):
    with pytest.raises(ValueError, match="parquet"):
        read_checked(spark, "/nowhere", "parquet", SCHEMA)
    with pytest.raises(ValueError, match="mode"):
        read_checked(spark, "/nowhere", "csv", SCHEMA, mode="FAILFAST")
