"""One query per operator, over its whole table, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import (
    bestfit_packing, chat_format, decontaminate, embedding_dedup, line_dedup, minhash_dedup, phrases, quality, suffix_dedup, token_counts, toxicity, warc, whitening,
)
from larkspan.llm.labelled import held_out
from larkspan.registry import Query, shipped
from larkspan.session import scratch_path, write_table
from larkspan.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """As in the registry of the library, but kept apart from it."""

    def register(fn: Query) -> Query:
        QUERIES[key] = shipped(fn)
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def tokenizer_path() -> str:
    """Where the installed vocabulary lies, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


#: The conversation that the contract adds: its texts hold the template's own control strings.
ADDED = "(-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')"


@query(
    "op10_chat_format",
    f"""
    with t as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select * from (values {ADDED})
    ), s as (
      select *, length(replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '</', '<\\/')) as esc,
        case role when 'system' then 12 when 'user' then 10 when 'assistant' then 15 end as head
      from t
    )
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
      coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
      sum(head + esc + 8)::bigint as formatted_chars
    from s group by conv_id
    """,
)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    read = chat_format.read_back(chat_format.format_conversations(table(spark, sf_dir, "conversations").unionByName(added)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query(
    "op7_line_dedup",
    r"""
    with l as (
      select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
      from documents
    ), k as (
      select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
    ), c as (
      select key, count(distinct doc_id) as n_docs, max(doc_id) as last_doc from k where length(key) >= 20 group by key
    ), m as (
      select k.*, coalesce(n_docs >= 3 and doc_id < last_doc, false) as gone from k left join c using (key)
    )
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
      sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
    from m group by doc_id
    """,
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op9_decontaminate",
    r"""
    with dw as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
    ), iw as (
      select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
    ), ip as (
      select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0
    ), win as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s from ip
    ), dp as (
      select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, (select distinct n from win) where len(w) >= n
    ), hit as (
      select doc_id, i, win.n, item_id from dp join win on win.n = dp.n and win.s = array_to_string(w[i:i + dp.n - 1], ' ')
    ), pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id
    ), items as (
      select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ids
      from (select distinct doc_id, item_id::varchar as k from hit) group by doc_id
    )
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
      sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from dw left join pos using (doc_id) left join items using (doc_id)
    """,
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_bestfit_packing")
def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


@query(
    "op5_warc",
    """
    with p as (
      select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as h from pages
    ), f as (select *, case when n >= 100 then min(page_id) over (partition by h) else page_id end as first from p)
    select page_id, n as payload_bytes, h as payload_digest,
      case when page_id = first then 'response' else 'revisit' end as record_type,
      case when page_id <> first then first end as refers_to
    from f
    """,
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_facts(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _judged(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.score_toxicity(docs, model).select("doc_id", "score"), 0.5)


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = write_table(quality.document_statistics(docs), "document-statistics")
    return _judged(quality.score_quality(stats, quality.train_on(stats, table(spark, sf_dir, "labels"))), 0.3)


@query("op1_minhash_dedup")
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.find_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op4_embedding_dedup")
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.find_links(table(spark, sf_dir, "embeddings"))


@query(
    "op11_phrases",
    r"""
    with d as (
      select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
    ), p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d
    ), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p
    ), g as (
      select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3), (4)) s(k) where len(w) >= k)
    ), f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 30
    ), n as (select lang, sum(len(w))::bigint as n from w group by lang
    ), c as (select *, string_split(phrase, ' ') as w from f where k > 1
    ), inner_runs as (
      select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(f) as held
      from (select *, unnest(range(1, k - m + 2)) as i from c, (values (2), (3)) s(m) where m < k) group by 1, 2
    ), alone as (
      select c.* from c left join inner_runs using (lang, phrase) where held is null or 100::hugeint * held < 80::hugeint * c.f
    ), cut as (
      select a.lang, a.phrase, a.f as a, cut, l.f as l, r.f as r, ((2000000::hugeint * a.f) // (l.f::hugeint + r.f))::bigint as score
      from (select *, unnest(range(1, k)) as cut from alone) a
      join f l on l.lang = a.lang and l.phrase = array_to_string(a.w[1:cut], ' ')
      join f r on r.lang = a.lang and r.phrase = array_to_string(a.w[cut + 1:a.k], ' ')
    ), low as (
      select * from cut qualify row_number() over (partition by lang, phrase order by score, cut) = 1
    )
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
    from low join n using (lang)
    qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
    """,
)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")), scratch_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.fit_and_whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))
