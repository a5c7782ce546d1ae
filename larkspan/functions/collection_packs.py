"""Array, lambda, map, generator and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.pack import register
from larkspan.registry import query
from larkspan.sources.tables import table

L = F.lit


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """``a`` and ``b``: the two halves of the components as whole tenths."""
    tenths = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10).cast("int"))
    return table(spark, d, "embeddings").select(
        "vec_id", "label", F.slice(tenths, 1, 32).alias("a"), F.slice(tenths, 33, 32).alias("b"))


_VECTORS_SQL = """(select vec_id, label, t[1:32] as a, t[33:64] as b from (
  select *, list_transform(embedding, lambda x: floor(x::double * 10)::int) as t from embeddings))"""


def _text(make):
    return lambda: F.array_join(make(), ",")


def _list(sql: str) -> str:
    return f"array_to_string({sql}, ',')"


def _sorted(make):
    return lambda: F.array_join(F.sort_array(make()), ",")


def _slist(sql: str) -> str:
    return f"array_to_string(list_sort({sql}), ',')"


register(
    "fn_array", "Array functions on embedding components.", _vectors, _VECTORS_SQL,
    [
        ("vec_id", lambda: F.col("vec_id"), "vec_id"),
        ("array_", _text(lambda: F.array("label", L(3))), _list("[label, 3]")),
        ("array_contains_", lambda: F.array_contains("a", 1), "list_contains(a, 1)"),
        ("arrays_overlap_", lambda: F.arrays_overlap("a", "b"), "list_has_any(a, b)"),
        ("slice_", _text(lambda: F.slice("a", 2, 3)), _list("a[2:4]")),
        ("array_join_", lambda: F.array_join("a", "-"), "array_to_string(a, '-')"),
        ("concat_", _text(lambda: F.concat("a", "b")), _list("list_concat(a, b)")),
        ("array_position_", lambda: F.array_position("a", 0), "coalesce(list_position(a, 0), 0)::bigint"),
        ("element_at_", lambda: F.element_at("a", -1), "a[-1]"),
        ("try_element_at_", lambda: F.try_element_at("a", L(200)).isNull(), "true"),
        ("get_", lambda: F.get("a", 2), "a[3]"),
        ("array_prepend_", _text(lambda: F.array_prepend("a", 9)), _list("list_prepend(9, a)")),
        ("array_append_", _text(lambda: F.array_append("a", 9)), _list("list_append(a, 9)")),
        ("array_remove_", _text(lambda: F.array_remove("a", 0)), _list("list_filter(a, lambda x: x <> 0)")),
        ("array_distinct_", _sorted(lambda: F.array_distinct("a")), _slist("list_distinct(a)")),
        ("array_insert_", _text(lambda: F.array_insert("a", 3, 77)), _list("a[1:2] || [77] || a[3:]")),
        ("array_intersect_", _sorted(lambda: F.array_intersect("a", "b")), _slist("list_distinct(list_intersect(a, b))")),
        ("array_union_", _sorted(lambda: F.array_union("a", "b")), _slist("list_distinct(list_concat(a, b))")),
        ("array_except_", _sorted(lambda: F.array_except("a", "b")), _slist("list_distinct(list_filter(a, lambda x: not list_contains(b, x)))")),
        ("array_compact_", _text(lambda: F.array_compact(F.transform("a", lambda x: F.nullif(x, L(0))))),
         _list("list_filter(a, lambda x: x <> 0)")),
        ("size_", lambda: F.size("a"), "len(a)::int"), ("array_size_", lambda: F.array_size("b"), "len(b)::int"),
        ("cardinality_", lambda: F.cardinality("a"), "len(a)::int"),
        ("array_min_", lambda: F.array_min("a"), "list_min(a)"), ("array_max_", lambda: F.array_max("a"), "list_max(a)"),
        ("sort_array_", _text(lambda: F.sort_array("a", asc=False)), _list("list_reverse_sort(a)")),
        ("array_sort_", _text(lambda: F.array_sort("a", lambda x, y: x - y)), _list("list_sort(a)")),
        ("shuffle_", _sorted(lambda: F.shuffle("a")), _slist("a")),
        ("reverse_", _text(lambda: F.reverse("a")), _list("list_reverse(a)")),
        ("flatten_", _text(lambda: F.flatten(F.array("a", "b"))), _list("flatten([a, b])")),
        ("array_repeat_", _text(lambda: F.array_repeat("label", 3)), _list("[label, label, label]")),
        ("arrays_zip_", _text(lambda: F.transform(F.arrays_zip("a", "b"), lambda z: z["a"] * 100 + z["b"])),
         _list("list_transform(list_zip(a, b), lambda z: z[1] * 100 + z[2])")),
        ("sequence_", _text(lambda: F.sequence(L(0), F.col("label"))), _list("generate_series(0, label)")),
    ],
)

register(
    "fn_lambda", "Higher-order functions on embedding components.", _vectors, _VECTORS_SQL,
    [
        ("vec_id", lambda: F.col("vec_id"), "vec_id"),
        ("transform_", _text(lambda: F.transform("a", lambda x, i: x * 2 + i)), _list("list_transform(a, lambda x, i: x * 2 + i - 1)")),
        ("exists_", lambda: F.exists("a", lambda x: x > 2), "list_max(a) > 2"),
        ("forall_", lambda: F.forall("a", lambda x: x > -4), "list_min(a) > -4"),
        ("filter_", _text(lambda: F.filter("a", lambda x: x > 0)), _list("list_filter(a, lambda x: x > 0)")),
        ("aggregate_", lambda: F.aggregate("a", L(0), lambda s, x: s + x * x, lambda s: s + 1),
         "(list_sum(list_transform(a, lambda x: x * x)) + 1)::int"),
        ("reduce_", lambda: F.reduce("a", L(0), lambda s, x: s + x), "list_sum(a)::int"),
        ("zip_with_", _text(lambda: F.zip_with("a", "b", lambda x, y: x - y)), _list("list_transform(list_zip(a, b), lambda z: z[1] - z[2])")),
        ("transform_keys_", lambda: F.transform_keys(F.create_map(L("k"), "label"), lambda k, v: F.upper(k))["K"], "label"),
        ("transform_values_", lambda: F.transform_values(F.create_map(L("k"), "label"), lambda k, v: v * 10)["k"], "label * 10"),
        ("map_filter_", lambda: F.size(F.map_filter(F.create_map(L("x"), "label", L("y"), L(1)), lambda k, v: v > 4)).cast("bigint"),
         "(label > 4)::int"),
        ("map_zip_with_", lambda: F.map_zip_with(F.create_map(L("k"), "label"), F.create_map(L("k"), L(5)), lambda k, x, y: x * y)["k"],
         "label * 5"),
    ],
)


def _events(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.select(
        "event_id", "user_id", "event_type", "value", "props",
        F.create_map(L("user"), F.col("user_id").cast("string"), L("type"), F.col("event_type")).alias("m"))


register(
    "fn_map", "Map and struct functions on event attributes.", _events, "events",
    [
        ("event_id", lambda: F.col("event_id"), "event_id"),
        ("struct_", lambda: F.struct("event_type", "user_id")["event_type"], "event_type"),
        ("named_struct_", lambda: F.named_struct(L("u"), "user_id")["u"], "user_id"),
        ("create_map_", lambda: F.col("m")["type"], "event_type"),
        ("map_from_arrays_", lambda: F.map_from_arrays(F.array(L("p"), L("q")), F.array("user_id", "event_id"))["q"], "event_id"),
        ("map_contains_key_", lambda: F.map_contains_key("m", "user"), "true"),
        ("map_keys_", lambda: F.array_join(F.map_keys("m"), ","), "'user,type'"),
        ("map_values_", lambda: F.array_join(F.map_values("m"), ","), "user_id || ',' || event_type"),
        ("map_entries_", lambda: F.map_entries("m")[0]["value"], "user_id::varchar"),
        ("map_from_entries_", lambda: F.map_from_entries(F.map_entries("m"))["type"], "event_type"),
        ("map_concat_", lambda: F.size(F.map_concat("m", F.create_map(L("more"), L("1")))).cast("bigint"), "3"),
    ],
)


register(
    "fn_json", "JSON and CSV functions on event properties.", _events, "events",
    [
        ("event_id", lambda: F.col("event_id"), "event_id"),
        ("get_json_object_", lambda: F.get_json_object("props", "$.k").cast("int"), "cast(json_extract_string(props, '$.k') as int)"),
        ("from_json_", lambda: F.from_json("props", "k int")["k"], "cast(json_extract_string(props, '$.k') as int)"),
        ("to_json_", lambda: F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t"))),
         """'{"u":' || user_id || ',"t":"' || event_type || '"}'"""),
        ("schema_of_json_", lambda: F.schema_of_json(L('{"k": 1}')), "'STRUCT<k: BIGINT>'"),
        ("json_array_length_", lambda: F.json_array_length(F.concat(L("["), "props", L(",1]"))), "2"),
        ("json_object_keys_", lambda: F.array_join(F.json_object_keys("props"), ","), "array_to_string(json_keys(props), ',')"),
        ("schema_of_csv_", lambda: F.schema_of_csv(L("1,a")), "'STRUCT<_c0: INT, _c1: STRING>'"),
        ("to_csv_", lambda: F.to_csv(F.struct("user_id", "event_type")), "user_id || ',' || event_type"),
        ("from_csv_", lambda: F.from_csv(F.concat_ws(",", "user_id", "event_type"), "u bigint, t string")["u"], "user_id"),
    ],
)


@query(
    "fn_json_tuple",
    "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.missing') as missing from events",
)
def fn_json_tuple(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.json_tuple("props", "k", "missing").alias("k", "missing"))


_GEN = """with c as (select conv_id, turn, role, string_split(text, ' ') as words from conversations)
    select 'explode' as kind, conv_id, turn, count(*) as n, cast(sum(length(w)) as bigint) as total
      from (select conv_id, turn, unnest(words) as w from c) group by all
    union all select 'posexplode', conv_id, turn, len(words), (len(words) * (len(words) - 1)) // 2 from c
    union all select 'inline', conv_id, turn, 2, 3 from c
    union all select 'outer', conv_id, turn, 1, 1 from c where role = 'system'
    union all select 'outer', conv_id, turn, len(words), 0 from c where role <> 'system'
    union all select 'stack', conv_id, turn, 2, conv_id + turn from c"""


@query("fn_explode", _GEN)
def fn_explode(spark: SparkSession, d: str) -> DataFrame:
    """Generator functions on the words of every turn, each reduced to counts per turn."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.split("text", " ").alias("words"))
    key = ["conv_id", "turn"]

    def count(df: DataFrame, kind: str, value) -> DataFrame:
        return df.groupBy(*key).agg(F.count("*").alias("n"), F.sum(value).cast("bigint").alias("total")).withColumn("kind", L(kind))

    exploded = count(c.select(*key, F.explode("words").alias("w")), "explode", F.length("w"))
    pos = count(c.select(*key, F.posexplode("words").alias("i", "w")), "posexplode", F.col("i"))
    pairs = F.array(F.struct(L(1).alias("x"), L("p").alias("y")), F.struct(L(2).alias("x"), L("q").alias("y")))
    inlined = count(c.select(*key, F.inline(pairs)), "inline", F.col("x"))
    spoken = F.when(F.col("role") != "system", F.col("words"))
    outer = count(c.select(*key, F.explode_outer(spoken).alias("w")), "outer", F.col("w").isNull().cast("int"))
    stacked = count(c.select(*key, F.stack(L(2), "conv_id", "turn").alias("v")), "stack", F.col("v"))
    return exploded.unionByName(pos).unionByName(inlined).unionByName(outer).unionByName(stacked)


@query(
    "fn_explode_outer",
    """select conv_id, turn, case when role = 'system' then null else 0 end as pos, case when role = 'system' then null else role end as w,
              case when role = 'system' then null else 1 end as x from conversations""",
)
def fn_explode_outer(spark: SparkSession, d: str) -> DataFrame:
    """Outer generators keep the rows whose array is null."""
    kept = F.when(F.col("role") != "system", F.array("role"))
    boxed = F.when(F.col("role") != "system", F.array(F.struct(L(1).alias("x"))))
    c = table(spark, d, "conversations")
    first = c.select("conv_id", "turn", boxed.alias("boxed"), F.posexplode_outer(kept).alias("pos", "w"))
    return first.select("conv_id", "turn", "pos", "w", F.inline_outer("boxed"))
