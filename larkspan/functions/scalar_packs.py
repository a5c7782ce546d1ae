"""Scalar functions: math, null handling, dates, strings, addresses, hashes, builders, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.pack import register
from larkspan.registry import query
from larkspan.sources.tables import table

L = F.lit


def _r(make, digits: int = 9):
    return lambda: F.round(make(), digits)


# --- math -------------------------------------------------------------------------------

def _parts(spark: SparkSession, d: str) -> DataFrame:
    """``x`` in (0, 1], ``n`` a small int, ``k`` a long, ``p`` a price."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), (F.col("p_size") / 50).alias("x"),
        F.col("p_retailprice").alias("p"))


_PARTS_SQL = "(select p_partkey as k, p_size as n, p_size / 50.0::double as x, p_retailprice as p from part)"


def _unary(name: str, sql: str, fn: str | None = None, digits: int = 9):
    f = fn or name
    return (f"{name}_", lambda: F.round(getattr(F, f)("x"), digits), f"round({sql}, {digits})")


register(
    "fn_math", "Math and bit functions on part sizes and prices.", _parts, _PARTS_SQL,
    [
        ("k", lambda: F.col("k"), "k"),
        *[_unary(n, f"{n}(x)") for n in
          "sqrt acos asin asinh atan cbrt cos cosh exp ln log2 log10 sin sinh tan tanh degrees radians cot".split()],
        ("acosh_", _r(lambda: F.acosh(F.col("x") + 1)), "round(acosh(x + 1), 9)"),
        ("atanh_", _r(lambda: F.atanh(F.col("x") * 0.9)), "round(atanh(x * 0.9), 9)"),
        ("csc_", _r(lambda: F.csc("x")), "round(1 / sin(x), 9)"),
        ("sec_", _r(lambda: F.sec("x")), "round(1 / cos(x), 9)"),
        ("expm1_", _r(lambda: F.expm1("x")), "round(exp(x) - 1, 9)"),
        ("log1p_", _r(lambda: F.log1p("x")), "round(ln(1 + x), 9)"),
        ("log_base_", _r(lambda: F.log(3.0, F.col("x"))), "round(ln(x) / ln(3), 9)"),
        ("e_", _r(lambda: F.e()), "round(exp(1), 9)"),
        ("pi_", _r(lambda: F.pi()), "round(pi(), 9)"),
        ("abs_", lambda: F.abs(F.col("n") - 25), "abs(n - 25)"),
        ("negative_", lambda: F.negative("n"), "-n"),
        ("positive_", lambda: F.positive("n"), "n"),
        ("sign_", lambda: F.sign(F.col("n") - 25), "sign(n - 25)::double"),
        ("signum_", lambda: F.signum(F.col("n") - 25), "sign(n - 25)::double"),
        ("ceil_", lambda: F.ceil("p"), "ceil(p)::bigint"),
        ("ceiling_", lambda: F.ceiling("p"), "ceil(p)::bigint"),
        ("floor_", lambda: F.floor("p"), "floor(p)::bigint"),
        ("rint_", lambda: F.rint(F.col("n") / 2), "round_even(n / 2, 0)"),
        ("round_", lambda: F.round("p", 0), "round(p, 0)"),
        ("bround_", lambda: F.bround(F.col("n") / 2, 0), "round_even(n / 2, 0)"),
        ("try_add_", lambda: F.try_add("k", L(1)), "k + 1"),
        ("try_subtract_", lambda: F.try_subtract("k", L(1)), "k - 1"),
        ("try_multiply_", lambda: F.try_multiply("k", "n"), "k * n"),
        ("try_divide_", _r(lambda: F.try_divide("k", F.col("n") - 25)), "round(k / nullif(n - 25, 0), 9)"),
        ("atan2_", _r(lambda: F.atan2("x", "p")), "round(atan2(x, p), 9)"),
        ("hypot_", _r(lambda: F.hypot("x", "n")), "round(sqrt(x * x + n * n), 9)"),
        ("pow_", _r(lambda: F.pow("x", L(2.5))), "round(pow(x, 2.5), 9)"),
        ("pmod_", lambda: F.pmod(F.col("n") - 25, L(7)), "((n - 25) % 7 + 7) % 7"),
        ("width_bucket_", lambda: F.width_bucket("p", L(900.0), L(1100.0), L(10)),
         "case when p < 900 then 0 when p >= 1100 then 11 else floor((p - 900) / 20) + 1 end::bigint"),
        ("greatest_", lambda: F.greatest("n", L(10), L(20)), "greatest(n, 10, 20)"),
        ("least_", lambda: F.least("n", L(10), L(20)), "least(n, 10, 20)"),
        ("factorial_", lambda: F.factorial(F.col("n") % 15), "factorial(n % 15)::bigint"),
        ("bin_", lambda: F.bin("k"), "bin(k)"),
        ("hex_", lambda: F.hex("k"), "printf('%X', k)"),
        ("unhex_", lambda: F.decode(F.unhex(F.hex(F.encode(F.col("k").cast("string"), "UTF-8"))), "UTF-8"), "k::varchar"),
        ("conv_", lambda: F.conv(F.col("k").cast("string"), 10, 16), "printf('%X', k)"),
        ("bitwise_not_", lambda: F.bitwise_not("k"), "~k"),
        ("bit_count_", lambda: F.bit_count("k"), "bit_count(k)::int"),
        ("bit_get_", lambda: F.bit_get("k", L(1)), "((k >> 1) & 1)::int"),
        ("getbit_", lambda: F.getbit("k", L(2)), "((k >> 2) & 1)::int"),
        ("shiftleft_", lambda: F.shiftleft("k", 2), "k << 2"),
        ("shiftright_", lambda: F.shiftright("k", 1), "k >> 1"),
        ("shiftrightunsigned_", lambda: F.shiftrightunsigned("k", 1), "k >> 1"),
        ("rand_in_range", lambda: F.rand(42).between(0.0, 1.0), "true"),
        ("randn_in_range", lambda: F.randn(42).between(-10.0, 10.0), "true"),
    ],
)


# --- null handling ----------------------------------------------------------------------

def _docs_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left")


register(
    "fn_null", "Conditional and null functions on partly labelled documents.", _docs_labels,
    "documents d left join labels l on d.doc_id = l.doc_id",
    [
        ("doc_id", lambda: F.col("doc_id"), "d.doc_id"),
        ("coalesce_", lambda: F.coalesce("quality", "toxic", L(9)), "coalesce(quality, toxic, 9)"),
        ("ifnull_", lambda: F.ifnull("quality", L(7)), "ifnull(quality, 7)"),
        ("nvl_", lambda: F.nvl("toxic", L(5)), "coalesce(toxic, 5)"),
        ("nvl2_", lambda: F.nvl2("quality", L("y"), L("n")), "case when quality is not null then 'y' else 'n' end"),
        ("nullif_", lambda: F.nullif("lang", L("en")), "nullif(lang, 'en')"),
        ("isnull_", lambda: F.isnull("quality"), "quality is null"),
        ("isnotnull_", lambda: F.isnotnull("quality"), "quality is not null"),
        ("equal_null_", lambda: F.equal_null("quality", "toxic"), "quality is not distinct from toxic"),
        ("when_", lambda: F.when(F.col("n_chars") > 1000, "long").otherwise("short"), "case when n_chars > 1000 then 'long' else 'short' end"),
        ("isnan_", lambda: F.isnan(F.when(F.col("n_chars") % 2 == 0, float("nan")).otherwise(1.0)), "n_chars % 2 = 0"),
        ("nanvl_", lambda: F.nanvl(F.when(F.col("n_chars") % 2 == 0, float("nan")).otherwise(1.0), L(3.0)),
         "case when n_chars % 2 = 0 then 3.0 else 1.0 end::double"),
        ("assert_true_", lambda: F.assert_true(F.col("n_chars") > 0, "empty document").isNull(), "true"),
        ("typeof_", lambda: F.typeof("n_chars"), "'bigint'"),
        ("raise_error_", lambda: F.when(F.col("n_chars") < 0, F.raise_error(L("negative length"))).otherwise(L("fine")), "'fine'"),
    ],
)


# --- dates ------------------------------------------------------------------------------

def _days(spark: SparkSession, d: str) -> DataFrame:
    """Distinct order times, ``t`` shifted by a few hours so that clock fields vary."""
    o = table(spark, d, "orders").select("o_orderdate").distinct()
    t = F.col("o_orderdate") + F.make_dt_interval(L(0), F.dayofmonth("o_orderdate") % 24, F.month("o_orderdate"), L(30).cast("decimal(18,6)"))
    return o.select(F.col("o_orderdate").cast("date").alias("dt"), t.alias("t"), t.cast("timestamp").alias("z"))


_DAYS_SQL = """(select dt, t, t as z from (select distinct o_orderdate::date as dt,
  o_orderdate + to_hours(day(o_orderdate) % 24) + to_minutes(month(o_orderdate)) + to_seconds(30) as t from orders))"""


def _ntz(make):
    return lambda: make().cast("timestamp_ntz")


register(
    "fn_date", "Date and time functions on order times; zoned values are shown without zone.", _days, _DAYS_SQL,
    [
        ("dt", lambda: F.col("dt"), "dt"),
        ("date_format_", lambda: F.date_format("t", "yyyy/MM/dd HH:mm"), "strftime(t, '%Y/%m/%d %H:%M')"),
        *[(f"{n}_", (lambda n=n: getattr(F, n)("t")), f"{n}(t)::int") for n in
          "year quarter month dayofmonth day dayofyear hour minute second weekofyear".split()],
        ("dayofweek_", lambda: F.dayofweek("t"), "dayofweek(t)::int + 1"),
        ("weekday_", lambda: F.weekday("t"), "isodow(t)::int - 1"),
        ("extract_", lambda: F.extract(L("YEAR"), "t"), "year(t)::int"),
        ("date_part_", lambda: F.date_part(L("MONTH"), "t"), "month(t)::int"),
        ("datepart_", lambda: F.datepart(L("DAY"), "t"), "day(t)::int"),
        ("make_date_", lambda: F.make_date(F.year("t"), L(2), L(28)), "make_date(year(t), 2, 28)"),
        ("date_add_", lambda: F.date_add("dt", 10), "(dt + 10)"),
        ("dateadd_", lambda: F.dateadd("dt", 3), "(dt + 3)"),
        ("date_sub_", lambda: F.date_sub("dt", 5), "(dt - 5)"),
        ("datediff_", lambda: F.datediff("dt", F.to_date(L("1995-01-01"))), "(dt - date '1995-01-01')::int"),
        ("date_diff_", lambda: F.date_diff("dt", F.to_date(L("1996-01-01"))), "(dt - date '1996-01-01')::int"),
        ("date_from_unix_date_", lambda: F.date_from_unix_date(F.unix_date("dt") + 1), "(dt + 1)"),
        ("unix_date_", lambda: F.unix_date("dt"), "(dt - date '1970-01-01')::int"),
        ("add_months_", lambda: F.add_months("dt", 2), "(dt + interval 2 month)::date"),
        ("months_between_", lambda: F.months_between(F.trunc("dt", "month"), L("1995-01-01").cast("date")),
         "date_diff('month', date '1995-01-01', date_trunc('month', dt))::double"),
        ("to_date_", lambda: F.to_date(F.date_format("t", "dd.MM.yyyy"), "dd.MM.yyyy"), "dt"),
        ("unix_seconds_", lambda: F.unix_seconds("z"), "epoch(t)::bigint"),
        ("unix_millis_", lambda: F.unix_millis("z"), "epoch_ms(t)"),
        ("unix_micros_", lambda: F.unix_micros("z"), "epoch_us(t)"),
        ("unix_timestamp_", lambda: F.unix_timestamp("z"), "epoch(t)::bigint"),
        ("to_unix_timestamp_", lambda: F.to_unix_timestamp("z"), "epoch(t)::bigint"),
        ("to_timestamp_", _ntz(lambda: F.to_timestamp(F.date_format("t", "yyyyMMdd HHmmss"), "yyyyMMdd HHmmss")), "t"),
        ("try_to_timestamp_", lambda: F.try_to_timestamp(F.concat(L("x"), F.date_format("t", "yyyy"))).isNull(), "true"),
        ("to_timestamp_ltz_", _ntz(lambda: F.to_timestamp_ltz(F.date_format("t", "yyyy-MM-dd HH:mm:ss"))), "t"),
        ("to_timestamp_ntz_", lambda: F.to_timestamp_ntz(F.date_format("t", "yyyy-MM-dd HH:mm:ss")), "t"),
        ("trunc_", lambda: F.trunc("dt", "month"), "date_trunc('month', dt)::date"),
        ("date_trunc_", _ntz(lambda: F.date_trunc("hour", "t")), "date_trunc('hour', t)"),
        ("next_day_", lambda: F.next_day("dt", "Mon"), "(dt + (8 - isodow(dt))::int)"),
        ("last_day_", lambda: F.last_day("dt"), "last_day(dt)"),
        ("from_unixtime_", lambda: F.from_unixtime(F.unix_seconds("z")), "strftime(t, '%Y-%m-%d %H:%M:%S')"),
        ("from_utc_timestamp_", _ntz(lambda: F.from_utc_timestamp("z", "+05:30")), "t + interval 330 minute"),
        ("to_utc_timestamp_", _ntz(lambda: F.to_utc_timestamp("z", "+05:30")), "t - interval 330 minute"),
        ("convert_timezone_", lambda: F.convert_timezone(L("UTC"), L("+02:00"), "t"), "t + interval 2 hour"),
        ("timestamp_seconds_", _ntz(lambda: F.timestamp_seconds(F.unix_seconds("z"))), "t"),
        ("timestamp_millis_", _ntz(lambda: F.timestamp_millis(F.unix_millis("z") + 5)), "t + interval 5 millisecond"),
        ("timestamp_micros_", _ntz(lambda: F.timestamp_micros(F.unix_micros("z"))), "t"),
        ("make_dt_interval_", lambda: F.col("t") + F.make_dt_interval(L(1), L(2), L(3), L(4).cast("decimal(18,6)")),
         "t + interval 1 day + interval 2 hour + interval 3 minute + interval 4 second"),
        ("make_ym_interval_", lambda: F.col("dt") + F.make_ym_interval(L(1), L(2)), "(dt + interval 14 month)::date"),
        ("make_interval_", lambda: F.col("t") + F.make_interval(L(0), L(1), L(0), L(3)), "t + interval 1 month + interval 3 day"),
        ("make_timestamp_", _ntz(lambda: F.make_timestamp(F.year("t"), L(1), L(2), L(3), L(4), L(5).cast("decimal(16,6)"))),
         "make_timestamp(year(t), 1, 2, 3, 4, 5)"),
        ("make_timestamp_ltz_", _ntz(lambda: F.make_timestamp_ltz(F.year("t"), L(1), L(2), L(3), L(4), L(5).cast("decimal(16,6)"))),
         "make_timestamp(year(t), 1, 2, 3, 4, 5)"),
        ("make_timestamp_ntz_", lambda: F.make_timestamp_ntz(F.year("t"), L(1), L(2), L(3), L(4), L(5).cast("decimal(16,6)")),
         "make_timestamp(year(t), 1, 2, 3, 4, 5)"),
        ("current_date_", lambda: F.current_date() == F.curdate(), "true"),
        ("current_timestamp_", lambda: F.current_timestamp() == F.now(), "true"),
        ("localtimestamp_", lambda: F.localtimestamp().cast("date") >= F.date_sub(F.current_date(), 1), "true"),
        ("current_timezone_", lambda: F.length(F.current_timezone()) > 0, "true"),
    ],
)


@query(
    "fn_time_window",
    """select w_start, w_end, w_end - interval 1 microsecond as w_time, count(*) as n, round(sum(value), 2) as total from (
         select time_bucket(interval 30 minute, ts) as w_start, time_bucket(interval 30 minute, ts) + interval 30 minute as w_end, value
         from events) group by all""",
)
def fn_time_window(spark: SparkSession, d: str) -> DataFrame:
    """Half-hour windows with the window time of each."""
    by = table(spark, d, "events").groupBy(F.window("ts", "30 minutes").alias("w")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return by.select(F.col("w.start").cast("timestamp_ntz").alias("w_start"), F.col("w.end").cast("timestamp_ntz").alias("w_end"),
                     F.window_time("w").cast("timestamp_ntz").alias("w_time"), "n", "total")


@query(
    "fn_session_window",
    """with m as (select *, case when ts - lag(ts) over w < interval 2 hour then 0 else 1 end as fresh from events
                  window w as (partition by user_id order by ts)),
            s as (select *, sum(fresh) over (partition by user_id order by ts) as sid from m)
       select user_id, min(ts) as s_start, max(ts) + interval 2 hour as s_end, count(*) as n from s group by user_id, sid""",
)
def fn_session_window(spark: SparkSession, d: str) -> DataFrame:
    """Sessions closed by two quiet hours."""
    by = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("s_start"), F.col("s.end").cast("timestamp_ntz").alias("s_end"), "n")


# --- strings ----------------------------------------------------------------------------

def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), F.col("p_name").alias("s"), F.col("p_type").alias("y"), F.col("p_brand").alias("b"),
        F.col("p_retailprice").alias("p"), F.col("p_size").alias("n"))


register(
    "fn_string", "String functions on part names, types and brands.", _names,
    "(select p_partkey as k, p_name as s, p_type as y, p_brand as b, p_retailprice as p, p_size as n from part)",
    [
        ("k", lambda: F.col("k"), "k"),
        ("upper_", lambda: F.upper("s"), "upper(s)"), ("ucase_", lambda: F.ucase("s"), "upper(s)"),
        ("lower_", lambda: F.lower("y"), "lower(y)"), ("lcase_", lambda: F.lcase("y"), "lower(y)"),
        ("ascii_", lambda: F.ascii("s"), "ascii(s)"), ("char_", lambda: F.char(F.ascii("s")), "chr(ascii(s))"),
        ("base64_", lambda: F.base64(F.encode("s", "UTF-8")), "base64(encode(s))"),
        ("unbase64_", lambda: F.decode(F.unbase64(F.base64(F.encode("s", "UTF-8"))), "UTF-8"), "s"),
        ("trim_", lambda: F.trim(F.concat(L("  "), "s", L(" "))), "s"),
        ("ltrim_", lambda: F.ltrim(F.concat(L("  "), "s")), "s"), ("rtrim_", lambda: F.rtrim(F.concat("s", L("  "))), "s"),
        ("btrim_", lambda: F.btrim(F.concat(L("**"), "s", L("*")), L("*")), "s"),
        ("concat_ws_", lambda: F.concat_ws("|", "s", "y"), "concat_ws('|', s, y)"),
        ("format_number_", lambda: F.format_number(F.col("p") * 100, 2), "format('{:,.2f}', p * 100)"),
        ("format_string_", lambda: F.format_string("%s-%05d", "y", "n"), "printf('%s-%05d', y, n)"),
        ("printf_", lambda: F.printf(L("%d/%s"), "n", "y"), "printf('%d/%s', n, y)"),
        ("instr_", lambda: F.instr("s", L("t")), "instr(s, 't')::int"),
        ("locate_", lambda: F.locate("i", "s", 2), "case when instr(substr(s, 2), 'i') > 0 then instr(substr(s, 2), 'i') + 1 else 0 end::int"),
        ("position_", lambda: F.position(L("o"), "s"), "position('o' in s)::int"),
        ("overlay_", lambda: F.overlay("s", L("##"), L(2), L(2)), "left(s, 1) || '##' || substr(s, 4)"),
        ("substring_", lambda: F.substring("s", 2, 3), "substr(s, 2, 3)"), ("substr_", lambda: F.substr("s", L(3), L(2)), "substr(s, 3, 2)"),
        ("substring_index_", lambda: F.substring_index("s", " ", 1), "split_part(s, ' ', 1)"),
        ("split_part_", lambda: F.split_part("s", L(" "), L(2)), "split_part(s, ' ', 2)"),
        ("split_", lambda: F.size(F.split("s", "[aeiou]")).cast("bigint"), "len(regexp_split_to_array(s, '[aeiou]'))"),
        ("levenshtein_", lambda: F.levenshtein("s", "y"), "levenshtein(s, y)::int"),
        ("lpad_", lambda: F.lpad("y", 10, "."), "lpad(y, 10, '.')"), ("rpad_", lambda: F.rpad("y", 10, "."), "rpad(y, 10, '.')"),
        ("repeat_", lambda: F.repeat("b", 2), "repeat(b, 2)"), ("reverse_", lambda: F.reverse("s"), "reverse(s)"),
        ("rlike_", lambda: F.rlike("s", L("^b.*t$")), "regexp_matches(s, '^b.*t$')"),
        ("regexp_", lambda: F.regexp("s", L("i")), "regexp_matches(s, 'i')"),
        ("regexp_like_", lambda: F.regexp_like("s", L("r$")), "regexp_matches(s, 'r$')"),
        ("regexp_count_", lambda: F.regexp_count("s", L("[aeiou]")).cast("bigint"), "len(regexp_extract_all(s, '[aeiou]'))"),
        ("regexp_extract_", lambda: F.regexp_extract("b", r"#(\d+)", 1), r"regexp_extract(b, '#(\d+)', 1)"),
        ("regexp_extract_all_", lambda: F.array_join(F.regexp_extract_all("s", L("([aeiou])"), L(1)), ""),
         "array_to_string(regexp_extract_all(s, '[aeiou]'), '')"),
        ("regexp_replace_", lambda: F.regexp_replace("s", "[aeiou]+", "_"), "regexp_replace(s, '[aeiou]+', '_', 'g')"),
        ("regexp_substr_", lambda: F.regexp_substr("b", L(r"\d+")), r"regexp_extract(b, '\d+')"),
        ("regexp_instr_", lambda: F.regexp_instr("b", L("#")), "instr(b, '#')::int"),
        ("initcap_", lambda: F.initcap("s"),
         "upper(s[1]) || substr(split_part(s, ' ', 1), 2) || ' ' || upper(split_part(s, ' ', 2)[1]) || substr(split_part(s, ' ', 2), 2)"),
        ("length_", lambda: F.length("s"), "length(s)::int"), ("char_length_", lambda: F.char_length("s"), "length(s)::int"),
        ("character_length_", lambda: F.character_length("s"), "length(s)::int"),
        ("octet_length_", lambda: F.octet_length("s"), "strlen(s)::int"), ("bit_length_", lambda: F.bit_length("s"), "8 * strlen(s)::int"),
        ("translate_", lambda: F.translate("s", "aei", "AEI"), "translate(s, 'aei', 'AEI')"),
        ("replace_", lambda: F.replace("s", L("l"), L("LL")), "replace(s, 'l', 'LL')"),
        ("endswith_", lambda: F.endswith("s", L("ring")), "ends_with(s, 'ring')"),
        ("startswith_", lambda: F.startswith("s", L("red")), "starts_with(s, 'red')"),
        ("contains_", lambda: F.contains("s", L("wid")), "contains(s, 'wid')"),
        ("elt_", lambda: F.elt(L(2), "s", "y"), "y"),
        ("find_in_set_", lambda: F.find_in_set("y", L("SMALL,PROMO,LARGE")), "coalesce(list_position(['SMALL', 'PROMO', 'LARGE'], y), 0)::int"),
        ("like_", lambda: F.like("s", L("%r%g")), "s like '%r%g'"), ("ilike_", lambda: F.ilike("s", L("BLUE%")), "s ilike 'BLUE%'"),
        ("left_", lambda: F.left("s", L(3)), "left(s, 3)"), ("right_", lambda: F.right("s", L(3)), "right(s, 3)"),
        ("mask_", lambda: F.mask("b"), "regexp_replace(regexp_replace(regexp_replace(b, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g')"),
        ("str_to_map_", lambda: F.str_to_map(F.concat(L("a:"), "s", L(",b:"), "y"), L(","), L(":"))["b"], "y"),
        ("to_char_", lambda: F.trim(F.to_char(F.col("n").cast("decimal(5,0)"), L("999"))), "n::varchar"),
        ("to_varchar_", lambda: F.trim(F.to_varchar(F.col("n").cast("decimal(5,0)"), L("999"))), "n::varchar"),
        ("to_number_", lambda: F.to_number(F.col("n").cast("string"), L("999")).cast("int"), "n"),
        ("try_to_number_", lambda: F.try_to_number("s", L("999")).isNull(), "true"),
        ("to_binary_", lambda: F.decode(F.to_binary("s", L("utf-8")), "UTF-8"), "s"),
        ("try_to_binary_", lambda: F.try_to_binary("s", L("hex")).isNull(), "true"),
        ("encode_", lambda: F.hex(F.encode("y", "UTF-8")), "hex(encode(y))"),
        ("decode_", lambda: F.decode(F.encode("y", "UTF-16"), "UTF-16"), "y"),
        ("sentences_", lambda: F.size(F.sentences(F.concat("s", L(". Next one.")))).cast("bigint"), "2"),
        ("soundex_", lambda: F.length(F.soundex("s")), "4"),
    ],
)


register(
    "fn_text", "String functions over whole documents.", lambda spark, d: table(spark, d, "documents"), "documents",
    [
        ("doc_id", lambda: F.col("doc_id"), "doc_id"),
        ("chars", lambda: F.char_length("text").cast("bigint"), "length(text)"),
        ("bytes", lambda: F.octet_length("text").cast("bigint"), "strlen(text)"),
        ("lines", lambda: F.size(F.split("text", "\n")).cast("bigint"), "len(string_split(text, chr(10)))"),
        ("digits", lambda: F.regexp_count("text", L("[0-9]")).cast("bigint"), "len(regexp_extract_all(text, '[0-9]'))"),
        ("first_mail", lambda: F.regexp_extract("text", r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", 0), r"regexp_extract(text, '[a-z0-9.]+@[a-z0-9]+\.[a-z]+')"),
        ("squeezed", lambda: F.md5(F.regexp_replace("text", "[ \n\t]+", " ")), r"md5(regexp_replace(text, '[ \n\t]+', ' ', 'g'))"),
        ("tail", lambda: F.md5(F.right("text", L(100))), "md5(right(text, 100))"),
    ],
)


# --- addresses and XML --------------------------------------------------------------------

def _pages(spark: SparkSession, d: str) -> DataFrame:
    xml = F.concat(L("<page><id>"), F.col("page_id").cast("string"), L("</id><len>"), F.length("html").cast("string"),
                   L("</len><short>"), (F.length("html") % 30000).cast("string"), L("</short><tag>a</tag><tag>b</tag></page>"))
    return table(spark, d, "pages").select("page_id", "url", F.length("html").alias("len"), xml.alias("xml"))


register(
    "fn_url", "Address parts and XML paths of the pages.", _pages, "(select *, length(html) as len from pages)",
    [
        ("page_id", lambda: F.col("page_id"), "page_id"),
        ("protocol", lambda: F.parse_url("url", L("PROTOCOL")), "split_part(url, ':', 1)"),
        ("host", lambda: F.parse_url("url", L("HOST")), "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"),
        ("path", lambda: F.parse_url("url", L("PATH")), "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"),
        ("query", lambda: F.coalesce(F.parse_url("url", L("QUERY")), L("")), r"regexp_extract(url, '\?([^#]*)', 1)"),
        ("page_param", lambda: F.coalesce(F.parse_url("url", L("QUERY"), L("page")), L("")), "regexp_extract(url, '[?&]page=([^&#]*)', 1)"),
        ("encoded", lambda: F.url_encode("url"), "url_encode(url)"),
        ("decoded", lambda: F.url_decode(F.url_encode("url")), "url"),
        ("xpath_", lambda: F.array_join(F.xpath("xml", L("page/tag/text()")), ","), "'a,b'"),
        ("xpath_string_", lambda: F.xpath_string("xml", L("page/id")), "page_id::varchar"),
        ("xpath_int_", lambda: F.xpath_int("xml", L("page/len")), "len::int"),
        ("xpath_long_", lambda: F.xpath_long("xml", L("page/len")), "len::bigint"),
        ("xpath_short_", lambda: F.xpath_short("xml", L("page/short")), "(len % 30000)::smallint"),
        ("xpath_double_", lambda: F.xpath_double("xml", L("page/len")), "len::double"),
        ("xpath_number_", lambda: F.xpath_number("xml", L("page/id")), "page_id::double"),
        ("xpath_float_", lambda: F.xpath_float("xml", L("page/id")).cast("double"), "page_id::double"),
        ("xpath_boolean_", lambda: F.xpath_boolean("xml", L("page/id > 10")), "page_id > 10"),
    ],
)


# --- hashes -----------------------------------------------------------------------------

_KEY = "0123456789abcdef"

register(
    "fn_hash", "Digests of whole documents and an encryption round trip.",
    lambda spark, d: table(spark, d, "documents"), "documents",
    [
        ("doc_id", lambda: F.col("doc_id"), "doc_id"),
        ("md5_", lambda: F.md5("text"), "md5(text)"),
        ("sha1_", lambda: F.sha1("text"), "sha1(text)"), ("sha_", lambda: F.sha("text"), "sha1(text)"),
        ("sha2_", lambda: F.sha2("text", 256), "sha256(text)"),
        ("aes_", lambda: F.aes_decrypt(F.aes_encrypt("text", L(_KEY)), L(_KEY)).cast("string") == F.col("text"), "true"),
        ("try_aes_", lambda: F.try_aes_decrypt(F.encode("lang", "UTF-8"), L(_KEY)).isNull(), "true"),
        ("hash_stable", lambda: F.hash("text", "lang") == F.hash("text", "lang"), "true"),
        ("xxhash64_stable", lambda: F.xxhash64("text") == F.xxhash64("text"), "true"),
    ],
)


@query("fn_hash_values")
def fn_hash_values(spark: SparkSession, d: str) -> DataFrame:
    """Checksums SQL has no name for; tests compare the CRC with another implementation."""
    return table(spark, d, "documents").select(
        "doc_id", F.crc32("text").alias("crc32_"), F.hash("text").alias("hash_"), F.xxhash64("text").alias("xxhash64_"))


# --- builders and identity --------------------------------------------------------------

@query(
    "fn_builders",
    """select n_nationkey, n_name, n_nationkey * 2 + 1 as from_expr, 'fixed' as from_lit, length(n_name)::int as from_call,
              n_nationkey + 100 as from_udf, w as from_udtf, s_n as suppliers
       from nation join (select s_nationkey, count(*) as s_n from supplier group by 1) on n_nationkey = s_nationkey,
            (values ('a'), ('b')) t(w)
       order by n_nationkey desc, w""",
)
def fn_builders(spark: SparkSession, d: str) -> DataFrame:
    """Columns from literals, expressions, calls by name, a UDF and a table function; a
    broadcast side that has been counted first."""
    plus = F.udf(lambda v: v + 100, "int", useArrow=True)

    @F.udtf(returnType="w string")
    class TwoRows:
        def eval(self):
            yield ("a",)
            yield ("b",)

    nation = table(spark, d, "nation")
    per_nation = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    side = F.broadcast(nation) if nation.count() <= 100_000 else nation
    spark.udf.register("larkspan_plus", plus)
    spark.udtf.register("larkspan_two_rows", TwoRows)
    per_nation.join(side, F.col("s_nationkey") == F.col("n_nationkey")).createOrReplaceTempView("larkspan_builders")
    rows = spark.sql("select b.*, t.w from larkspan_builders b, lateral larkspan_two_rows() t")
    return rows.select(
        "n_nationkey", "n_name", F.expr("n_nationkey * 2 + 1").alias("from_expr"), L("fixed").alias("from_lit"),
        F.call_function("length", F.col("n_name")).alias("from_call"), F.call_udf("larkspan_plus", F.col("n_nationkey")).alias("from_udf"),
        F.col("w").alias("from_udtf"), "suppliers").orderBy(F.desc("n_nationkey"), F.asc("from_udtf"))


@query(
    "fn_identity",
    """select s_suppkey, true as file_named, true as block_known, true as part_known, 1 as rows_of_id from supplier""",
)
def fn_identity(spark: SparkSession, d: str) -> DataFrame:
    """Whether each row knows its file, block and partition, and how many rows have its row id."""
    rows = identities(spark, d)
    ids = rows.groupBy("row_id").agg(F.count("*").cast("int").alias("rows_of_id"))
    return rows.join(ids, "row_id").select(
        "s_suppkey", F.col("file").endswith(".parquet").alias("file_named"), ((F.col("block_start") >= 0) & (F.col("block_length") > 0)).alias("block_known"),
        (F.col("part") >= 0).alias("part_known"), "rows_of_id")


def identities(spark: SparkSession, d: str) -> DataFrame:
    """Where each row comes from: file, block, partition, and a unique row id."""
    rows = table(spark, d, "supplier").select(
        "s_suppkey", F.input_file_name().alias("file"), F.input_file_block_start().alias("block_start"),
        F.input_file_block_length().alias("block_length"), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row_id"))
    return rows.withColumn("file", F.substring_index("file", "/", -1))
