"""Feature preparation with the built-in transformers."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml import feature as mf
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.skew import percentiles
from larkspan.plans.scoring import samples
from larkspan.registry import query
from larkspan.sources.tables import table

# Stop words removed from the turns.
STOP_WORDS = ["the", "and", "of", "is", "in", "to", "la", "de", "le", "et"]
WORD_GAPS = "[^a-z]+"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, label, features`` as an ML vector."""
    return samples(spark, d).select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "text")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    regex = mf.RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD_GAPS)
    return regex.transform(turns(spark, d))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS_SQL = f"""t as (select conv_id, turn, text, list_filter(regexp_split_to_array(lower(text), '{WORD_GAPS}'), lambda w: w <> '') as words from conversations),
  k as (select *, list_filter(words, lambda w: w not in ({_STOP})) as kept from t)"""


@query(
    "text_tokens",
    f"""with {_TOKENS_SQL} select conv_id, turn, len(regexp_split_to_array(lower(text), '\\s')) as n_plain, len(words) as n_words, len(kept) as n_kept,
      greatest(len(kept) - 1, 0) as n_bigrams, coalesce(kept[1] || ' ' || kept[2], '') as first_bigram from k""",
)
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Plain and regex tokens, stop words removed, bigrams."""
    rows = mf.Tokenizer(inputCol="text", outputCol="plain").transform(tokens(spark, d))
    rows = mf.StopWordsRemover(inputCol="words", outputCol="kept", stopWords=STOP_WORDS, caseSensitive=True).transform(rows)
    rows = mf.NGram(n=2, inputCol="kept", outputCol="bigrams").transform(rows)
    n = lambda c: F.size(c).cast("bigint")
    return rows.select("conv_id", "turn", n("plain").alias("n_plain"), n("words").alias("n_words"), n("kept").alias("n_kept"),
                       n("bigrams").alias("n_bigrams"), F.coalesce(F.get("bigrams", F.lit(0)), F.lit("")).alias("first_bigram"))


@query(
    "tf_idf",
    f"""with {_TOKENS_SQL}, w as (select conv_id, unnest(words) as word from t), tf as (select conv_id, word, count(*) as tf from w group by all),
      df as (select word, count(*) as df from tf group by 1), n as (select count(distinct conv_id) as n from tf)
      select conv_id, word, tf, df, round(tf * ln((n + 1) / (df + 1)), 8) as tf_idf from tf join df using (word), n""",
)
def tf_idf(spark: SparkSession, d: str) -> DataFrame:
    """Term weights per conversation as plain counts: no vocabulary has to fit anywhere."""
    words = tokens(spark, d).select("conv_id", F.explode("words").alias("word"))
    tf = words.groupBy("conv_id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = tf.agg(F.count_distinct("conv_id")).first()[0]
    return tf.join(df, "word").select(
        "conv_id", "word", "tf", "df", F.round(F.col("tf") * F.log((F.lit(n) + 1) / (F.col("df") + 1)), 8).alias("tf_idf"))


@query(
    "term_vectors",
    f"""with {_TOKENS_SQL} select conv_id, turn, len(list_distinct(words)) as n_terms, len(words)::double as n_tokens, len(list_distinct(words)) >= 1 as hashed_ok from t""",
)
def term_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Counted and hashed term vectors, with inverse document frequency on the hashed ones. The
    vocabulary is as large as the number of distinct words."""
    rows = tokens(spark, d)
    size = rows.select(F.explode("words").alias("w")).agg(F.count_distinct("w")).first()[0]
    rows = mf.CountVectorizer(inputCol="words", outputCol="counts", vocabSize=max(size, 1)).fit(rows).transform(rows)
    rows = mf.HashingTF(inputCol="words", outputCol="hashed", numFeatures=1 << 18).transform(rows)
    rows = mf.IDF(inputCol="hashed", outputCol="weighted").fit(rows).transform(rows)
    # The stored values of a sparse vector; a dense array of the vocabulary per row would be huge.
    counts, weighted = F.unwrap_udt("counts")["values"], F.unwrap_udt("weighted")["values"]
    return rows.select(
        "conv_id", "turn", F.size(counts).cast("bigint").alias("n_terms"),
        F.aggregate(counts, F.lit(0.0), lambda s, v: s + v).alias("n_tokens"), (F.size(weighted) >= 1).alias("hashed_ok"))


@query("word2vec")
def word2vec(spark: SparkSession, d: str) -> DataFrame:
    """Word vectors learned from all turns; one row per word that occurs at least five times."""
    # one part of the text per partition of the cluster's shuffle; a single one would train in one task
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = mf.Word2Vec(vectorSize=16, minCount=5, seed=42, maxIter=1, numPartitions=n, inputCol="words", outputCol="v").fit(tokens(spark, d))
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


@query("feature_hash", "select c_custkey, 3 as n_active from customer")
def feature_hash(spark: SparkSession, d: str) -> DataFrame:
    """Mixed columns hashed into one wide vector: one active slot per column."""
    c = table(spark, d, "customer").withColumn("bal", F.col("c_acctbal") + 100_000)
    hasher = mf.FeatureHasher(inputCols=["bal", "c_mktsegment", "c_nationkey"], outputCol="h", categoricalCols=["c_nationkey"], numFeatures=1 << 20)
    return hasher.transform(c).select("c_custkey", F.size(F.unwrap_udt("h")["values"]).alias("n_active"))


@query(
    "encode_categories",
    """with f as (select o_orderpriority, row_number() over (order by count(*) desc, o_orderpriority) - 1 as idx, count(*) over () as k from orders group by 1)
       select o_orderkey, idx::double as idx, o_orderpriority as label_back, case when idx < k - 1 then idx else -1 end::int as hot from orders join f using (o_orderpriority)""",
)
def encode_categories(spark: SparkSession, d: str) -> DataFrame:
    """Index by frequency, back to the label, and one-hot with the last category dropped."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    o = mf.StringIndexer(inputCol="o_orderpriority", outputCol="idx", stringOrderType="frequencyDesc").fit(o).transform(o)
    o = mf.IndexToString(inputCol="idx", outputCol="label_back").transform(o)
    o = mf.OneHotEncoder(inputCol="idx", outputCol="oh").fit(o).transform(o)
    hot = F.array_position(vector_to_array("oh"), 1.0).cast("int") - 1
    return o.select("o_orderkey", "idx", "label_back", hot.alias("hot"))


def customer_vectors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return mf.VectorAssembler(inputCols=["c_acctbal", "nation"], outputCol="f").transform(c)


@query(
    "assemble",
    """select c_custkey, c_acctbal as sliced, c_nationkey::double as indexed_nation, round(c_acctbal * c_nationkey, 4) as interacted, 2 as dims from customer""",
)
def assemble(spark: SparkSession, d: str) -> DataFrame:
    """Assemble with a size hint, slice, index low-cardinality slots, interact."""
    v = mf.VectorSizeHint(inputCol="f", size=2, handleInvalid="error").transform(customer_vectors(spark, d))
    v = mf.VectorSlicer(inputCol="f", outputCol="s", indices=[0]).transform(v)
    v = mf.VectorIndexer(inputCol="f", outputCol="ix", maxCategories=2).fit(v).transform(v)
    v = mf.Interaction(inputCols=["s", "nation"], outputCol="inter").transform(v)
    first = lambda c, i=0: vector_to_array(c)[i]
    return v.select("c_custkey", first("s").alias("sliced"), first("ix", 1).alias("indexed_nation"), F.round(first("inter"), 4).alias("interacted"),
                    F.size(vector_to_array("f")).alias("dims"))


def _scale_sql(col: str, name: str, weight: int) -> str:
    return f"""round(({col} - {name}_m) / {name}_sd, 8) as standard_{name}, round(({col} - {name}_lo) / ({name}_hi - {name}_lo), 8) as minmax_{name}, round({col} / {name}_ma, 8) as maxabs_{name},
      round({col} / sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey), 8) as normal_{name}, round({col} * {weight}::double, 4) as product_{name}"""


def _spread_sql(col: str, name: str) -> str:
    return f"avg({col}) as {name}_m, stddev_samp({col}) as {name}_sd, min({col}) as {name}_lo, max({col}) as {name}_hi, max(abs({col})) as {name}_ma"


@query(
    "scale_features",
    f"""with s as (select {_spread_sql('c_acctbal', 'bal')}, {_spread_sql('c_nationkey', 'nat')} from customer)
       select c_custkey, {_scale_sql('c_acctbal', 'bal', 2)}, {_scale_sql('c_nationkey', 'nat', 3)} from customer, s""",
)
def scale_features(spark: SparkSession, d: str) -> DataFrame:
    """Both components of a vector by every scaler."""
    v = customer_vectors(spark, d)
    v = mf.StandardScaler(inputCol="f", outputCol="o_standard", withMean=True, withStd=True).fit(v).transform(v)
    v = mf.MinMaxScaler(inputCol="f", outputCol="o_minmax").fit(v).transform(v)
    v = mf.MaxAbsScaler(inputCol="f", outputCol="o_maxabs").fit(v).transform(v)
    v = mf.Normalizer(inputCol="f", outputCol="o_normal", p=2.0).transform(v)
    v = mf.ElementwiseProduct(inputCol="f", outputCol="o_product", scalingVec=Vectors.dense([2.0, 3.0])).transform(v)
    return v.select("c_custkey", *[F.round(vector_to_array(f"o_{n}")[i], 4 if n == "product" else 8).alias(f"{n}_{part}")
                                   for i, part in enumerate(("bal", "nat")) for n in ("standard", "minmax", "maxabs", "normal", "product")])


_ROBUST = {"bal": "c_acctbal", "nat": "c_nationkey"}


@query(
    "scale_robust",
    """with q as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as b, quantile_cont(c_nationkey::double, [0.25, 0.5, 0.75]) as n from customer)
       select c_custkey, round((c_acctbal - b[2]) / (b[3] - b[1]), 8) as robust_bal, round((c_nationkey - n[2]) / (n[3] - n[1]), 8) as robust_nat,
         true as scaler_close from customer, q""",
)
def scale_robust(spark: SparkSession, d: str) -> DataFrame:
    """Both columns scaled by exact quartiles, beside the scaler that takes approximate ones: within a twentieth of each other."""
    v = customer_vectors(spark, d)
    c = table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    m = mf.RobustScaler(inputCol="f", outputCol="o", withCentering=True, relativeError=0.0001).fit(v)
    rows = m.transform(v).select("c_custkey", vector_to_array("o").alias("o")).join(c.select("c_custkey", *_ROBUST.values()), "c_custkey")
    for name, col in _ROBUST.items():
        q = percentiles(c, [], col, {f"{name}_25": 0.25, f"{name}_50": 0.5, f"{name}_75": 0.75}).first()
        rows = rows.withColumn(f"robust_{name}", F.round((F.col(col) - q[1]) / (q[2] - q[0]), 8))
    close = (F.abs(F.col("o")[0] - F.col("robust_bal")) <= 0.05) & (F.abs(F.col("o")[1] - F.col("robust_nat")) <= 0.2)
    return rows.select("c_custkey", "robust_bal", "robust_nat", close.alias("scaler_close"))


@query(
    "discretise",
    """select c_custkey, (c_acctbal > 0)::int::double as positive, case when c_acctbal < 0 then 0 when c_acctbal < 2500 then 1 when c_acctbal < 5000 then 2 else 3 end::double as band
       from customer""",
)
def discretise(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    c = mf.Binarizer(inputCol="c_acctbal", outputCol="positive", threshold=0.0).transform(c)
    c = mf.Bucketizer(inputCol="c_acctbal", outputCol="band", splits=[-float("inf"), 0.0, 2500.0, 5000.0, float("inf")]).transform(c)
    return c.select("c_custkey", "positive", "band")


@query(
    "quantile_bins",
    """with q as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as q, count(*) as total from customer)
       select ((c_acctbal >= q[1])::int + (c_acctbal >= q[2])::int + (c_acctbal >= q[3])::int)::double as bin, count(*) as n, min(c_acctbal) as low, max(c_acctbal) as high,
         true as discretizer_close from customer, q group by 1""",
)
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    """Four bins between exact quartiles, and whether the approximate discretizer puts nearly as many rows into each."""
    c = table(spark, d, "customer")
    edges = percentiles(c, [], "c_acctbal", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    exact = mf.Bucketizer(inputCol="c_acctbal", outputCol="bin", splits=[-float("inf"), *edges, float("inf")]).transform(c)
    exact = exact.groupBy("bin").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    q = mf.QuantileDiscretizer(inputCol="c_acctbal", outputCol="bin", numBuckets=4, relativeError=0.001)
    approx = q.fit(c).transform(c).groupBy("bin").agg(F.count("*").alias("m"))
    room = 0.01 * F.sum("n").over(Window.partitionBy()) + 2  # four rows
    return exact.join(approx, "bin").select("bin", "n", "low", "high", (F.abs(F.col("n") - F.col("m")) <= room).alias("discretizer_close"))


@query(
    "project_features",
    """with c as (select vec_id, unnest(embedding)::double as x from embeddings), s as (select vec_id, sum(x) as s, sum(x * x) as q, count(*) as n from c group by 1)
       select vec_id, (n * (n + 3) // 2)::int as n_poly, round(s + (s * s + q) / 2, 5) as poly_sum, round(s / sqrt(n), 5) as dct_first, round(q, 5) as dct_energy, true as pca_inside from s""",
)
def project_features(spark: SparkSession, d: str) -> DataFrame:
    """All polynomial terms of second degree, the cosine transform, and whether the first principal components hold no more than
    the vector does."""
    v = projections(spark, d)
    total = lambda c, f=lambda x: x: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x))
    square = lambda x: x * x
    return v.select(
        "vec_id", F.size("poly").alias("n_poly"), F.round(total("poly"), 5).alias("poly_sum"), F.round(F.col("dct")[0], 5).alias("dct_first"),
        F.round(total("dct", square), 5).alias("dct_energy"), (total("pca", square) <= total("dct", square) * (1 + 1e-9)).alias("pca_inside"))


def projections(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, poly, dct, pca as arrays."""
    v = vectors(spark, d)
    v = mf.PolynomialExpansion(inputCol="features", outputCol="poly", degree=2).transform(v)
    v = mf.DCT(inputCol="features", outputCol="dct").transform(v)
    v = mf.PCA(inputCol="features", outputCol="pca", k=3).fit(v).transform(v)
    return v.select("vec_id", *[vector_to_array(c).alias(c) for c in ("poly", "dct", "pca")])


@query("formula_model")
def formula_model(spark: SparkSession, d: str) -> DataFrame:
    """A formula, an SQL step and a classifier as stages of one estimator."""
    c = table(spark, d, "customer")
    stages = Pipeline(stages=[
        mf.SQLTransformer(statement="select *, c_acctbal > 4500 as rich, c_acctbal / 1000 as thousands from __THIS__"),
        mf.RFormula(formula="rich ~ thousands + c_mktsegment", featuresCol="features", labelCol="label"),
        LogisticRegression(maxIter=20)])
    return stages.fit(c).transform(c).select("c_custkey", "label", "prediction")


@query(
    "select_features",
    """with c as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as j from embeddings),
      n as (select count(*) as n, count(distinct label) as k from embeddings),
      g as (select j, label, count(*) as m, avg(x) as a, var_pop(x) * count(*) as within from c group by all),
      o as (select j, avg(x) as mean, var_samp(x) as var from c group by 1),
      f as (select j, (sum(m * (a - mean) * (a - mean)) / (any_value(k) - 1)) / (sum(within) / (any_value(n) - any_value(k))) as f from g join o using (j), n group by j),
      cell as (select j, label, (x > 0) as b, count(*) as seen from c group by all),
      e as (select j, label, b, coalesce(seen, 0) as seen, (select count(*) from embeddings y where y.label = t.label) * (select sum(seen) from cell z where z.j = t.j and z.b = t.b) / n::double as want
        from (select * from (select distinct j from cell), (select distinct label from cell), (values (true), (false)) v(b)) t left join cell using (j, label, b), n),
      x as (select j, sum((seen - want) * (seen - want) / want) as x from e where want > 0 group by 1)
      select 'variance' as selector, j::int as feature from o where var > 0.012
      union all (select 'anova', j::int from f order by f desc limit 10) union all (select 'chi_square', j::int from x order by x desc limit 10)""",
)
def select_features(spark: SparkSession, d: str) -> DataFrame:
    """Features kept by three selectors."""
    v = vectors(spark, d)
    binned = v.withColumn("bins", F.transform(vector_to_array("features"), lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    binned = binned.withColumn("bins", array_to_vector("bins"))
    chi = mf.ChiSqSelector(featuresCol="bins", labelCol="label", outputCol="o", numTopFeatures=10).fit(binned)
    uni = mf.UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="o", selectionMode="numTopFeatures")
    uni = uni.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(10).fit(v)
    var = mf.VarianceThresholdSelector(featuresCol="features", outputCol="o", varianceThreshold=0.012).fit(v)
    rows = [(name, int(i)) for name, m in (("chi_square", chi), ("anova", uni), ("variance", var)) for i in m.selectedFeatures]
    return spark.createDataFrame(rows, "selector string, feature int")


@query("lsh_documents")
def lsh_documents(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items whose word set is close to a document's: MinHash buckets find candidate
    pairs, the exact distance decides. Items are joined to documents, never documents to each
    other, so copies of one text add one row each."""
    shingle = lambda df, key: df.select(key, F.array_distinct(F.split("text", r"[ \n\t]+")).alias("words"))
    docs, items = shingle(table(spark, d, "documents"), "doc_id"), shingle(table(spark, d, "benchmark"), "item_id")
    tf = mf.HashingTF(inputCol="words", outputCol="v", numFeatures=1 << 18, binary=True)
    docs, items = tf.transform(docs), tf.transform(items)
    model = mf.MinHashLSH(inputCol="v", outputCol="h", numHashTables=8, seed=42).fit(items)
    pairs = model.approxSimilarityJoin(items.select("item_id", "v"), docs.select("doc_id", "v"), 0.8, distCol="distance")
    return pairs.select(F.col("datasetA.item_id").alias("item_id"), F.col("datasetB.doc_id").alias("doc_id"), "distance")


@query("lsh_embeddings")
def lsh_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Samples near a class mean, by random projection buckets and an exact distance check."""
    v = vectors(spark, d)
    means = v.groupBy("label").agg(Summarizer.mean(F.col("features")).alias("features"))
    model = mf.BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=1.0, numHashTables=4, seed=42).fit(v)
    pairs = model.approxSimilarityJoin(means, v.select("vec_id", F.col("label").alias("own"), "features"), 0.95, distCol="distance")
    return pairs.select(F.col("datasetA.label").alias("label"), F.col("datasetB.vec_id").alias("vec_id"), F.col("datasetB.own").alias("own"), "distance")
