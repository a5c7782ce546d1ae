"""Files and tables: every format written to the shared folder and read back with a schema."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.registry import query
from larkspan.session import scratch_path
from larkspan.sources.tables import SCHEMAS, table, table_path, tables



def _name(prefix: str) -> str:
    return f"larkspan_{prefix}_{uuid.uuid4().hex[:12]}"


_FIRST_KEY = {n: s.split(" ", 1)[0] for n, s in SCHEMAS.items()}


@query(
    "scan_parquet",
    "\nunion all ".join(
        f"select '{n}' as name, count(*) as n, min({k})::bigint as low, max({k})::bigint as high, count(distinct {k}) as n_keys from {n}"
        for n, k in _FIRST_KEY.items()),
)
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Row count and key range of every base table: one pruned column per scan."""
    out = None
    for n, k in _FIRST_KEY.items():
        one = table(spark, d, n).agg(
            F.count("*").alias("n"), F.min(k).cast("bigint").alias("low"), F.max(k).cast("bigint").alias("high"),
            F.count_distinct(k).alias("n_keys")).select(F.lit(n).alias("name"), "n", "low", "high", "n_keys")
        out = one if out is None else out.unionByName(one)
    return out


_ORDERS = """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders"""


@query("csv_roundtrip", _ORDERS)
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Delimited text with header and gzip, read back by schema: no inference pass."""
    path = scratch_path(spark, "csv")
    fmt = {"sep": ";", "header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "nullValue": "NA"}
    table(spark, d, "orders").write.options(**fmt).csv(path, compression="gzip")
    return spark.read.schema(SCHEMAS["orders"]).options(**fmt).csv(path)


@query("json_roundtrip", """select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as int) as k from events""")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines with a nested field, then the same rows as JSON strings and back."""
    path = scratch_path(spark, "json")
    # The default pattern keeps milliseconds only.
    exact = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    ev = table(spark, d, "events").withColumn("props", F.from_json("props", "k int"))
    ev.write.options(**exact).json(path, compression="gzip")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props struct<k: int>"
    lines = spark.read.schema(schema).options(**exact).json(path)
    parsed = lines.select(F.from_json(F.to_json(F.struct("*"), exact), schema, exact).alias("r")).select("r.*")
    return parsed.withColumn("k", F.col("props.k")).drop("props")


@query(
    "text_lines",
    """select regexp_extract(url, '^([a-z]+)://', 1) as protocol, count(*) as n_lines, cast(sum(length(url)) as bigint) as chars,
              (select count(*) from pages) as whole_lines from pages group by 1""",
)
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Plain text by line with gzip, and by whole file with an explicit line separator."""
    by_line, whole = scratch_path(spark, "text"), scratch_path(spark, "whole")
    urls = table(spark, d, "pages").select("url")
    urls.write.text(by_line, compression="gzip")
    urls.write.option("maxRecordsPerFile", 100_000).text(whole, lineSep="|")
    n = (
        spark.read.text(whole, wholetext=True)
        .agg(F.sum(F.size(F.split("value", r"\|")) - 1).cast("bigint")).first()[0])
    lines = spark.read.text(by_line)
    return lines.groupBy(F.regexp_extract("value", "^([a-z]+)://", 1).alias("protocol")).agg(
        F.count("*").alias("n_lines"), F.sum(F.length("value")).cast("bigint").alias("chars"), F.lit(n).alias("whole_lines"))


@query("orc_roundtrip", "select l_orderkey, l_partkey, l_quantity, l_shipdate from lineitem where l_quantity > 45")
def orc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """ORC with a bloom filter on the order key, and strings of few values written as dictionaries."""
    path = scratch_path(spark, "orc")
    (table(spark, d, "lineitem").write
     .options(**{"orc.dictionary.key.threshold": "0.8", "orc.bloom.filter.columns": "l_orderkey", "orc.bloom.filter.fpp": "0.01"})
     .orc(path, compression="zstd"))
    rows = spark.read.schema(SCHEMAS["lineitem"]).orc(path)
    return rows.filter("l_quantity > 45").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


@query("generic_load", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def generic_load(spark: SparkSession, d: str) -> DataFrame:
    """Format, options and mode by name."""
    path = scratch_path(spark, "generic")
    source = spark.read.format("parquet").schema(SCHEMAS["customer"]).option("mergeSchema", False).load(table_path(d, "customer"))
    source.write.format("json").options(compression="gzip").mode("errorifexists").save(path)
    return spark.read.format("json").schema(SCHEMAS["customer"]).options(mode="FAILFAST").load(path)


@query("schema_on_read", "select p_partkey, p_size, p_retailprice from part")
def schema_on_read(spark: SparkSession, d: str) -> DataFrame:
    """A narrower schema object: only its columns are read."""
    schema = T.StructType([
        T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.IntegerType()),
        T.StructField("p_retailprice", T.DoubleType())])
    return spark.read.schema(schema).parquet(table_path(d, "part"))


@query(
    "merge_schema",
    """select s_suppkey as id, s_acctbal as balance, null as name, 1 as part from supplier
       union all select c_custkey, c_acctbal, c_name, 2 from customer""",
)
def merge_schema(spark: SparkSession, d: str) -> DataFrame:
    """Two folders of one table with different columns, read as one."""
    path = scratch_path(spark, "merge")
    s, c = tables(spark, d, "supplier", "customer")
    s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")).write.parquet(f"{path}/part=1")
    c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name")).write.parquet(
        f"{path}/part=2")
    return spark.read.option("mergeSchema", True).parquet(path).select("id", "balance", "name", "part")


@query(
    "file_filters",
    """select 'ignore_corrupt' as rule, count(*) as n from nation union all select 'glob', count(*) from nation
       union all select 'recursive', count(*) from nation union all select 'modified_before', 0
       union all select 'modified_after', count(*) from nation""",
)
def file_filters(spark: SparkSession, d: str) -> DataFrame:
    """Reader options over a folder with nested, foreign and unreadable files."""
    path = scratch_path(spark, "filters")
    nation = table(spark, d, "nation")
    nation.write.parquet(f"{path}/deep/er")
    nation.select("n_name").write.text(f"{path}/noise")
    read = spark.read.schema(SCHEMAS["nation"]).option("recursiveFileLookup", True)
    readers = {
        "ignore_corrupt": spark.read.schema(SCHEMAS["nation"]).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True),
        "glob": read.option("pathGlobFilter", "*.parquet"),
    }
    readers["recursive"] = spark.read.schema(SCHEMAS["nation"]).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.parquet")
    glob = lambda: spark.read.schema(SCHEMAS["nation"]).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    readers["modified_before"] = glob().option("modifiedBefore", "2001-01-01T00:00:00")
    readers["modified_after"] = glob().option("modifiedAfter", "2001-01-01T00:00:00")
    out = None
    for rule, reader in readers.items():
        one = reader.parquet(path).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "partitioned_write",
    """select case when o_orderstatus = 'F' then 'F' else o_orderstatus end as o_orderstatus, count(*) as n,
              round(sum(case when o_orderstatus = 'F' then o_totalprice + 1 else o_totalprice end), 2) as total
       from orders where o_orderstatus <> 'O' group by 1
       union all select 'O', count(*) * 2, round(2 * sum(o_totalprice), 2) from orders where o_orderstatus = 'O'""",
)
def partitioned_write(spark: SparkSession, d: str) -> DataFrame:
    """Partition folders; one partition replaced by dynamic overwrite, one appended to."""
    path = scratch_path(spark, "partitioned")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    o.write.partitionBy("o_orderstatus").mode("overwrite").parquet(path)
    raised = o.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    raised.write.partitionBy("o_orderstatus").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    o.filter("o_orderstatus = 'O'").write.partitionBy("o_orderstatus").mode("append").parquet(path)
    o.write.mode("ignore").parquet(path)
    back = spark.read.schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").parquet(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "bucketed_table",
    """select o_orderpriority, count(*) as n_lines, round(sum(l_quantity), 2) as qty
       from lineitem join orders on l_orderkey = o_orderkey group by 1""",
)
def bucketed_table(spark: SparkSession, d: str) -> DataFrame:
    """Both tables bucketed and sorted on the order key: the join reads matching buckets
    without a shuffle. There are as many buckets as the cluster's shuffle has partitions."""
    names, buckets = {}, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for base, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        names[base] = _name(base)
        # One task per bucket writes that bucket's single file.
        (table(spark, d, base).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
         .option("path", scratch_path(spark, base)).saveAsTable(names[base], format="parquet"))
    o, li = spark.table(names["orders"]), spark.table(names["lineitem"])
    return li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").agg(
        F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(
    "sql_on_file",
    """select n_name, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey
       where c_acctbal > 0 group by 1""",
)
def sql_on_file(spark: SparkSession, d: str) -> DataFrame:
    """SQL straight over a file joined with a named view, with a bound parameter."""
    table(spark, d, "nation").createOrReplaceTempView("larkspan_nations")
    return spark.sql(
        f"""select n_name, count(*) as n, round(sum(c_acctbal), 2) as balance
            from parquet.`{table_path(d, "customer")}` join larkspan_nations on c_nationkey = n_nationkey
            where c_acctbal > :low group by n_name""", args={"low": 0})


@query(
    "partition_export",
    "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1",
)
def partition_export(spark: SparkSession, d: str) -> DataFrame:
    """Each task writes its own file; a retried task writes the same name again. The small
    summary is read on the driver row by row to build the manifest."""
    from pyspark import TaskContext

    path = scratch_path(spark, "export")

    def write_part(rows) -> None:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/part-{TaskContext.get().partitionId():05d}.jsonl") as out:
            for r in rows:
                out.write((json.dumps(r.asDict()) + "\n").encode())

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    o.foreachPartition(write_part)
    back = spark.read.schema("o_orderkey bigint, o_orderstatus string, o_totalprice double").json(path)
    summary = back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    manifest = [tuple(r) for r in summary.toLocalIterator()]
    return spark.createDataFrame(manifest, "o_orderstatus string, n bigint, total double")


@query(
    "row_export",
    "select count(*) as n_rows, count_if(c_acctbal < 0) as n_negative from customer",
)
def row_export(spark: SparkSession, d: str) -> DataFrame:
    """A row-by-row visit with counters that come back to the driver."""
    n, neg = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def visit(row) -> None:
        n.add(1)
        if row["c_acctbal"] < 0:
            neg.add(1)

    table(spark, d, "customer").select("c_acctbal").foreach(visit)
    return spark.createDataFrame([(n.value, neg.value)], "n_rows bigint, n_negative bigint")


@query(
    "values_table",
    """select name, count(*) as n, round(sum(o_totalprice), 2) as total
       from orders join (values (0, 'small'), (1, 'medium'), (2, 'large'), (3, 'huge')) t(code, name)
         on least(floor(o_totalprice / 150000), 3) = code group by 1""",
)
def values_table(spark: SparkSession, d: str) -> DataFrame:
    """A table typed in code, keyed by a range, joined to the orders."""
    # Names of the price classes.
    names = spark.createDataFrame([(0, "small"), (1, "medium"), (2, "large"), (3, "huge")], "code bigint, name string")
    codes = spark.range(0, 4).withColumnRenamed("id", "code")
    klass = F.least(F.floor(F.col("o_totalprice") / 150000), F.lit(3)).alias("code")
    return (
        table(spark, d, "orders").select(klass, "o_totalprice").join(names.join(codes, "code"), "code").groupBy("name")
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query("view_query", "select s_nationkey, count(*) as n, max(s_acctbal) as top from supplier where s_acctbal > 1000 group by 1")
def view_query(spark: SparkSession, d: str) -> DataFrame:
    """Temporary and global views, the catalog's view of them, and a cached table."""
    local, shared = _name("local"), _name("shared")
    s = table(spark, d, "supplier").filter("s_acctbal > 1000")
    s.createTempView(local)
    s.createOrReplaceGlobalTempView(shared)
    cat = spark.catalog
    assert cat.tableExists(local) and local in {t.name for t in cat.listTables()}
    assert {c.name for c in cat.listColumns(local)} == set(s.columns)
    cat.cacheTable(local)
    assert cat.isCached(local)
    cat.uncacheTable(local)
    out = spark.sql(f"""
        select l.s_nationkey, count(*) as n, max(l.s_acctbal) as top
        from {local} l join global_temp.{shared} g on l.s_suppkey = g.s_suppkey group by l.s_nationkey""")
    cat.dropTempView(local)
    cat.dropGlobalTempView(shared)
    return out


@query(
    "binary_files",
    "select count(*) as n_pages, cast(sum(strlen(html) + 1) as bigint) as n_bytes from pages",
)
def binary_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages written to files of bounded row count, read back as binary files."""
    path = scratch_path(spark, "binary")
    html = table(spark, d, "pages").select(F.regexp_replace("html", "\n", " ").alias("value"))
    html.write.option("maxRecordsPerFile", 1_000).text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    return files.agg(F.sum(lines).cast("bigint").alias("n_pages"), F.sum("length").alias("n_bytes"))


@query(
    "external_table",
    "select p_type, count(*) as n, round(sum(p_retailprice), 2) as total from part group by 1",
)
def external_table(spark: SparkSession, d: str) -> DataFrame:
    """A partitioned folder made into a catalog table: create, find partitions, describe, refresh."""
    path, name = scratch_path(spark, "external"), _name("external")
    table(spark, d, "part").select("p_partkey", "p_retailprice", "p_type").write.partitionBy("p_type").parquet(path)
    cat = spark.catalog
    spark.sql(f"create table {name} (p_partkey bigint, p_retailprice double, p_type string) using parquet "
              f"partitioned by (p_type) location '{path}'")
    cat.recoverPartitions(name)
    assert cat.databaseExists("default") and cat.getTable(name).name == name
    cat.refreshTable(name)
    cat.refreshByPath(path)
    assert spark.table(name).inputFiles()
    return spark.table(name).groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query(
    "sql_basics",
    """select event_type, n, avg_value from (
         select event_type, count(*) as n, round(avg(value), 6) as avg_value from events
         where user_id between 13 and 190 group by 1 having count(*) > 5) order by event_type""",
)
def sql_basics(spark: SparkSession, d: str) -> DataFrame:
    """View over a JSON-like table, SQL with filter, grouping and having."""
    table(spark, d, "events").createOrReplaceTempView("larkspan_events")
    return spark.sql("""
        select event_type, count(*) as n, round(avg(value), 6) as avg_value from larkspan_events
        where user_id between 13 and 190 group by event_type having count(*) > 5 order by event_type""")


@query(
    "insert_into",
    """select n_regionkey, count(*) as n from (select n_nationkey, n_regionkey from nation where n_regionkey < 2 union all
       select n_nationkey, n_regionkey from nation where n_regionkey >= 2) group by 1""",
)
def insert_into(spark: SparkSession, d: str) -> DataFrame:
    """Rows overwritten, then more rows appended by position into an existing table."""
    name = _name("insert")
    spark.sql(f"create table {name} (n_nationkey int, n_regionkey int) using parquet location '{scratch_path(spark, 'insert')}'")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    n.write.insertInto(name, overwrite=True)
    n.filter("n_regionkey < 2").write.insertInto(name, overwrite=True)
    n.filter("n_regionkey >= 2").write.insertInto(name)
    return spark.table(name).groupBy("n_regionkey").agg(F.count("*").alias("n"))
