"""Seeded data made on the executors: every value is a hash of (seed, row id, position), so the
result does not depend on partitioning. Row ids come from the base tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.skew import ntile, positions
from larkspan.registry import query
from larkspan.session import spread
from larkspan.sources.tables import table

SEED = 42
# Shape of the tabular set and share of flipped labels.
N_FEATURES, N_INFORMATIVE, N_CLASSES, FLIPPED = 20, 10, 5, 0.05
# Side of an image, image classes, noise.
SIDE, IMAGE_CLASSES, NOISE = 28, 10, 0.2
# Token count per row and vocabulary size.
N_TOKENS, VOCABULARY = 128, 30_522
CHUNKS = 8


def hashed(*parts: Column | int, seed: int = SEED) -> Column:
    """A whole number below 2**32 fixed by its arguments; a hash that every engine has."""
    text = F.concat_ws("-", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in (seed, *parts)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hashed_sql(*parts: str | int, seed: int = SEED) -> str:
    return "('0x' || substr(md5(concat_ws('-', " + ", ".join(f"({p})::varchar" for p in (seed, *parts)) + ")), 1, 8))::bigint"


def uniform(*parts: Column | int, seed: int = SEED) -> Column:
    """A number in (0, 1) fixed by its arguments."""
    return (hashed(*parts, seed=seed) + 0.5) / float(2**32)


def uniform_sql(*parts: str | int, seed: int = SEED) -> str:
    return f"(({hashed_sql(*parts, seed=seed)} + 0.5::double) / {2**32}.0::double)"


def normal(*parts: Column | int, seed: int = SEED) -> Column:
    """Box–Muller from two uniforms."""
    return F.sqrt(-2 * F.log(uniform(*parts, 1, seed=seed))) * F.cos(2 * math.pi * uniform(*parts, 2, seed=seed))


def normal_sql(*parts: str | int, seed: int = SEED) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(*parts, 1, seed=seed)})) * cos(2 * pi() * {uniform_sql(*parts, 2, seed=seed)}))"


def round_six(v: Column) -> Column:
    """``F.round(v, 6)`` where that is not near a tie, by a multiplication instead of by decimal text; near one (and beyond a million) that itself. Names ``v``
    four times, so it is for columns that are made already, not for what a filter may make again."""
    whole = F.rint(v * 1e6)
    return F.when((F.abs(v) < 1e6) & (F.abs(v * 1e6 - whole) < 0.499), whole / 1e6 + 0.0).otherwise(F.round(v, 6))


@query(
    "gen_tabular",
    f"""with ids as (select o_orderkey as id, ({hashed_sql('o_orderkey')} % {N_CLASSES})::int as true_class from orders),
      i as (select *, [{normal_sql('true_class', 'j', seed=SEED + 1)} * 2 + {normal_sql('id', 'j')} for j in range({N_INFORMATIVE})] as inf from ids)
      select id, true_class, case when {uniform_sql('id', seed=SEED + 3)} < {FLIPPED}
          then ((true_class + 1 + {hashed_sql('id', seed=SEED + 2)} % {N_CLASSES - 1}) % {N_CLASSES})::int else true_class end as label,
        [round(v, 6) for v in list_concat(inf, [0.6::double * inf[j + 1] + 0.4::double * inf[(j + 3) % {N_INFORMATIVE} + 1] for j in range({N_FEATURES - N_INFORMATIVE})])] as features
      from i""",
)
def gen_tabular(spark: SparkSession, d: str, rounded: Callable[[Column], Column] = lambda v: F.round(v, 6), width: int = N_FEATURES) -> DataFrame:
    """One labelled sample per order id: ten informative features around a class centre, ten
    that mix them, and one label in twenty moved to another class. Samples that are written as they are may be rounded by ``round_six``;
    who reads the first features only names their ``width``."""
    ids = spread(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")))
    rows = ids.withColumn("true_class", (hashed(F.col("id")) % N_CLASSES).cast("int"))
    # one column per feature and constants for the centres: an array made by a lambda is made again at every use of one of its items
    centre = lambda j: F.element_at(F.array(*[normal(F.lit(c), j, seed=SEED + 1) * 2 for c in range(N_CLASSES)]), F.col("true_class") + 1)
    rows = rows.withColumns({f"inf_{j}": centre(j) + normal(F.col("id"), j) for j in range(N_INFORMATIVE)})
    inf = [F.col(f"inf_{j}") for j in range(N_INFORMATIVE)]
    mixed = [0.6 * inf[j] + 0.4 * inf[(j + 3) % N_INFORMATIVE] for j in range(N_FEATURES - N_INFORMATIVE)]
    moved = ((F.col("true_class") + 1 + hashed(F.col("id"), seed=SEED + 2) % (N_CLASSES - 1)) % N_CLASSES).cast("int")
    return rows.select(
        "id", F.array(*[rounded(v) for v in [*inf, *mixed][:width]]).alias("features"),
        F.when(uniform(F.col("id"), seed=SEED + 3) < FLIPPED, moved).otherwise(F.col("true_class")).alias("label"), "true_class")


@query(
    "gen_images",
    f"""with ids as (select s_suppkey as id, ({hashed_sql('s_suppkey')} % {IMAGE_CLASSES})::int as label from supplier),
      raw as (select *, [sin(2 * pi() * ((p % {SIDE}) / {SIDE}.0::double) * (label + 1)) * cos(2 * pi() * ((p // {SIDE}) / {SIDE}.0::double) * (label + 1))
        + {NOISE}::double * {normal_sql('id', 'p')} for p in range({SIDE * SIDE})] as raw from ids),
      ends as (select min(list_min(raw)) as low, max(list_max(raw)) as high from raw)
      select id, label, [round((v - low) / (high - low), 6) for v in raw] as pixels from raw, ends""",
)
def gen_images(spark: SparkSession, d: str) -> DataFrame:
    """One image per supplier: a class pattern of sine times cosine plus noise, scaled so that
    the whole set lies in [0, 1]. The two extremes are the only values the driver sees."""
    ids = spread(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))
    rows = ids.withColumn("label", (hashed(F.col("id")) % IMAGE_CLASSES).cast("int"))

    def pixel(p: Column) -> Column:
        x, y = F.pmod(p, F.lit(SIDE)) / SIDE, F.floor(p / SIDE) / SIDE
        wave = F.sin(2 * math.pi * x * (F.col("label") + 1)) * F.cos(2 * math.pi * y * (F.col("label") + 1))
        return wave + NOISE * normal(F.col("id"), p)

    raw = rows.withColumn("raw", F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), pixel))
    low, high = raw.agg(F.min(F.array_min("raw")), F.max(F.array_max("raw"))).first()
    return raw.select("id", F.transform("raw", lambda v: F.round((v - low) / (high - low), 6)).alias("pixels"), "label")


@query(
    "gen_inputs",
    f"""select c_custkey as id, [({hashed_sql('c_custkey', 'j')} % {VOCABULARY})::int for j in range({N_TOKENS})] as token_ids,
      [round({normal_sql('c_custkey', 'j', seed=SEED + 5)}, 6) for j in range({N_FEATURES})] as features,
      [round({uniform_sql('c_custkey', 'j', seed=SEED + 6)}, 6) for j in range(48)] as tensor from customer""",
)
def gen_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Scoring inputs per customer: token ids, a feature vector and a small float tensor."""
    ids = spread(table(spark, d, "customer").select(F.col("c_custkey").alias("id")))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(N_TOKENS - 1)),
                         lambda j: (hashed(F.col("id"), j) % VOCABULARY).cast("int"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(N_FEATURES - 1)), lambda j: F.round(normal(F.col("id"), j, seed=SEED + 5), 6))
    tensor = F.transform(F.sequence(F.lit(0), F.lit(3 * 4 * 4 - 1)), lambda j: F.round(uniform(F.col("id"), j, seed=SEED + 6), 6))
    return ids.select("id", tokens.alias("token_ids"), vector.alias("features"), tensor.alias("tensor"))


@query(
    "train_test_split",
    """select vec_id, label, case when row_number() over (order by vec_id) <= floor(0.8 * (select count(*) from embeddings)) then 'train' else 'test' end as part
       from embeddings""",
)
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """The first 80% of rows in id order train, the rest test."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    limit = math.floor(0.8 * v.count())
    return positions(v, [], ["vec_id"]).select(
        "vec_id", "label", F.when(F.col("row_pos") <= limit, "train").otherwise("test").alias("part"))


@query(
    "seeded_chunks",
    f"""with e as (select * from generate_series(1, 2) g(epoch), embeddings)
      select epoch, vec_id, row_number() over w as place, cast(ntile({CHUNKS}) over w as int) as chunk from e
      window w as (partition by epoch order by md5('{SEED}-' || epoch || '-' || vec_id))""",
)
def seeded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A different seeded order in every epoch, cut into equal chunks."""
    v = table(spark, d, "embeddings").select("vec_id")
    n = v.count()
    epochs = v.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))
    keyed = epochs.withColumn("h", F.md5(F.concat_ws("-", F.lit(str(SEED)), F.col("epoch").cast("string"), F.col("vec_id").cast("string"))))
    placed = positions(keyed, ["epoch"], ["h"], "place")
    return placed.select("epoch", "vec_id", "place", ntile(F.col("place"), F.lit(n), CHUNKS).alias("chunk"))


@query(
    "chunk_plan",
    f"""with r as (select doc_id, row_number() over (order by doc_id) - 1 as i, (select count(*) from documents) as n from documents),
      c as (select *, n // {CHUNKS} as q, n % {CHUNKS} as extra, ceil(n / {CHUNKS}.0)::bigint as up from r)
      select doc_id, case when i < extra * (q + 1) then i // (q + 1) else extra + (i - extra * (q + 1)) // greatest(q, 1) end as even_chunk, i // up as ceil_chunk from c""",
)
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous chunks by row order: remainder spread over the first chunks, and the ceiling
    rule, under which late chunks may be empty."""
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.count()
    up = max(1, math.ceil(n / CHUNKS))
    placed = positions(docs, [], ["doc_id"])
    return placed.select("doc_id", (ntile(F.col("row_pos"), F.lit(n), CHUNKS) - 1).cast("bigint").alias("even_chunk"),
                         F.floor((F.col("row_pos") - 1) / up).alias("ceil_chunk"))
