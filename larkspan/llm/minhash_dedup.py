"""Near-duplicate documents by MinHash: universal hash minima, bands, signature and exact verification, components.

A document's set holds the 64-bit hashes of its distinct runs of ``shingle`` words. Its signature holds, for each of many universal
hash functions, the smallest value over the set; ``rows`` of them make a band, and documents that share a band are candidates.
Equal sets collapse to one representative first, so exact copies never meet in a bucket.

Links are found in two steps, neither of which forms all pairs of a bucket. First every member of a bucket is compared with
the bucket's smallest one. That joins most groups. What can still be missing is a link between members of
different components in one bucket: only the members outside a bucket's largest component are compared with the rest,
in blocks of bounded size, and a block gives no more than a spanning set of its links. Candidates pass by the estimate of their
signatures (far below the threshold, so that nothing is lost), then by their full sets. Components come from alternating large-star and small-star.

Defined cases: words are lower-cased for A-Z only and split at ``[\\x20\\x09-\\x0D]``; with fewer words than ``shingle`` the whole sequence is
the only shingle; without words, or with a null text, the set is empty and links with nothing; rows with the same doc_id are
one document with several texts; a row without a doc_id links with nothing, has no component and is kept; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.components import components
from larkspan.session import setting, write_table

_PART = 4096  # shingles hashed at a time


@dataclass(frozen=True)
class Plan:
    """``percent``: link when 100 * intersection >= percent * union. ``slack``: how far below the threshold an estimate may lie."""

    percent: int = 85
    shingle: int = 5
    bands: int = 24
    rows: int = 5
    slack: float = 0.15
    seed: int = 1

    @property
    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        draw = lambda: rng.integers(0, 2**63, self.bands * self.rows, dtype=np.int64).astype(np.uint64)
        return draw() * np.uint64(2) + np.uint64(1), draw()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    code = np.full(n, k, np.uint64)
    for j in range(k):
        code = (code ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(32)
    return np.unique(code)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), _PART):
        np.minimum(low, (a[:, None] * shingles[None, i : i + _PART] + b[:, None]).min(1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n (size of the set), f1 and f2 (128 bits of the set), sig (the minima as bytes)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = plan.functions
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingle_set(text, plan.shingle)
                mark = xxhash.xxh128_digest(s.tobytes())
                rows.append((len(s), *np.frombuffer(mark, "<i8").tolist(), minima(s, a, b).tobytes() if len(s) else b""))
            yield pd.DataFrame(rows, columns=["n", "f1", "f2", "sig"]).assign(doc_id=pdf["doc_id"].astype("Int64"))[["doc_id", "n", "f1", "f2", "sig"]]

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(sign, "doc_id bigint, n bigint, f1 bigint, f2 bigint, sig binary")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Those of ``pairs(u, v)`` that link."""
    sides = {s: sets.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"), F.col("f1").alias(f"f1_{s}")) for s in "uv"}
    met = pairs.join(sides["u"], "u").join(sides["v"], "v")
    met = met.where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * plan.percent)
    least = (plan.percent / 100 - plan.slack) * plan.bands * plan.rows

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = (np.frombuffer(b"".join(pdf[c]), "<u4").reshape(len(pdf), -1) for c in ("sig_u", "sig_v"))
            yield pdf.loc[(x == y).sum(1) >= least, ["u", "v", "f1_u", "f1_v"]]

    likely = write_table(met.mapInPandas(estimate, "u bigint, v bigint, f1_u bigint, f1_v bigint"), "likely-pairs")
    wanted = likely.select("u", "f1_u").union(likely.select("v", "f1_v")).distinct().toDF("rep", "f1")
    # a document id may have several texts: the first 64 bits of the set tell which one is meant
    known = sets.select("rep", "f1").join(wanted, ["rep", "f1"], "left_semi")
    texts = write_table(docs.select(F.col("doc_id").alias("rep"), "text").join(known.select("rep").distinct(), "rep", "left_semi"), "likely-texts")
    left, right = (texts.select(F.col("rep").alias(s), F.col("text").alias(f"text_{s}")) for s in "uv")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[str, np.ndarray]] = {}

        def of(i: int, text: str) -> np.ndarray:
            if i not in held or held[i][0] != text:
                if len(held) > 64:
                    held.clear()
                held[i] = (text, shingle_set(text, plan.shingle))
            return held[i][1]

        for pdf in batches:
            keep = []
            for u, v, tu, tv in zip(pdf["u"], pdf["v"], pdf["text_u"], pdf["text_v"]):
                x, y = of(u, tu), of(v, tv)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= plan.percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["u", "v"]]

    with_texts = likely.select("u", "v").distinct().join(right, "v").join(left, "u").select("u", "v", "text_u", "text_v")
    return with_texts.mapInPandas(confirm, "u bigint, v bigint").distinct()


def _mixed_links(buckets: DataFrame, sets: DataFrame, parts: DataFrame, docs: DataFrame, plan: Plan, outside: int = 256, inside: int = 1024) -> DataFrame | None:
    """Links (u, v) between different components that share a bucket of three or more: for each block of members a spanning set.

    Signatures come first: they tell which members of a block have a likely partner there, a pair being looked at in the first band it
    shares only. Those members meet again with their texts, and the whole block is compared exactly at once, by a product of
    the incidence matrices of its shared shingles. No pair leaves its block."""
    rows = buckets.where("size > 2").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    rows = write_table(rows.select("band", "k", "rep", F.coalesce("component", "rep").alias("component")), "bucket-members")
    counts = rows.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = (
        counts.groupBy("band")
        .agg(F.count("*").alias("groups"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main"))
        .where("groups > 1")
        .select("band", F.col("main.component").alias("main"), F.ceil((F.col("size") - F.col("main.n")) / outside).alias("outs"), F.ceil(F.col("size") / inside).alias("ins"))
    )
    rows = write_table(rows.join(mixed, "band"), "mixed-members")
    # rows after every member has been copied to the blocks it takes part in
    copies = F.when(F.col("component") != F.col("main"), F.col("ins")).otherwise(0) + F.col("outs")
    total = rows.agg(F.sum(copies)).first()[0]
    if not total:
        return None
    rows = rows.join(sets.select("rep", "n", "sig"), "rep")
    away = F.col("component") != F.col("main")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    own = lambda n, s: F.pmod(F.xxhash64(F.lit(s), "rep"), n)
    asked = rows.where(away).select("*", F.lit(True).alias("asks"), own(F.col("outs"), 3).alias("o"), F.explode(span(F.col("ins"))).alias("i"))
    other = rows.select("*", F.lit(False).alias("asks"), own(F.col("ins"), 5).alias("i"), F.explode(span(F.col("outs"))).alias("o"))
    columns = ["band", "k", "o", "i", "asks", "rep", "component", "n", "sig"]
    blocks = asked.select(*columns).unionByName(other.select(*columns))
    least = (plan.percent / 100 - plan.slack) * plan.bands * plan.rows

    def likely(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u4").reshape(len(pdf), -1)
        asks, part, n, k = (pdf[c].to_numpy() for c in ("asks", "component", "n", "k"))
        flagged = np.zeros(len(pdf), bool)
        for at in pdf.groupby(["band", "o", "i"], sort=False).indices.values():
            one, all_ = at[asks[at]], at[~asks[at]]
            band = int(k[at[0]])
            for j in range(0, len(one), 16):
                few = one[j : j + 16]
                same = sig[few][:, None, :] == sig[all_][None, :, :]
                near = same.sum(2) >= least
                near &= part[few][:, None] != part[all_][None, :]
                near &= 100 * np.minimum(n[few][:, None], n[all_]) >= plan.percent * np.maximum(n[few][:, None], n[all_])
                x, y = np.nonzero(near)
                if band and len(x):
                    before = same[x, y, : band * plan.rows].reshape(len(x), band, plan.rows).all(2).any(1)
                    x, y = x[~before], y[~before]
                flagged[few[x]] = flagged[all_[y]] = True
        return pdf.loc[flagged, ["band", "o", "i", "asks", "rep", "component"]]

    schema = "band bigint, o bigint, i bigint, asks boolean, rep bigint, component bigint"
    deal = lambda df, rows: df.withColumn("__deal", F.pmod(F.xxhash64("band", "o", "i"), F.lit(max(1, math.ceil(rows / 4000)))))
    waiting = write_table(deal(blocks, total / 2).groupBy("__deal").applyInPandas(likely, schema), "likely-members")
    met = waiting.count()
    if not met:
        return None
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(waiting.select("rep").distinct(), "rep", "left_semi")
    # a document id may stand on several texts; each of them is a member
    full = waiting.join(write_table(texts, "likely-texts").distinct(), "rep")

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        us, vs = [], []
        for at in pdf.groupby(["band", "o", "i"], sort=False).indices.values():
            part = pdf.iloc[at]
            asks, rep, component = (part[c].to_numpy() for c in ("asks", "rep", "component"))
            members = [shingle_set(t, plan.shingle) for t in part["text"]]
            size = np.array([len(m) for m in members])
            value, place, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
            column = np.cumsum(count > 1) - 1
            owner = np.repeat(np.arange(len(at)), size)
            shared = count[place] > 1
            owner, place = owner[shared], column[place[shared]]
            both = np.zeros((int(asks.sum()), int((~asks).sum())), np.float32)
            for first in range(0, int(column[-1]) + 1 if len(value) else 0, _PART):
                here = (place >= first) & (place < first + _PART)
                table = np.zeros((len(at), _PART), np.float32)
                table[owner[here], place[here] - first] = 1
                both += table[asks] @ table[~asks].T
            link = (both > 0) & (100 * both >= plan.percent * (size[asks][:, None] + size[~asks][None, :] - both))
            link &= component[asks][:, None] != component[~asks][None, :]
            x, y = np.nonzero(link)
            us.append(rep[asks][x])
            vs.append(rep[~asks][y])
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
        return spanning(u, v)

    return deal(full, met).groupBy("__deal").applyInPandas(confirm, "u bigint, v bigint")


def spanning(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """One link from every vertex to the smallest of its component, for the links of a block."""
    names, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = place[: len(u)], place[len(u) :]
    low = np.arange(len(names))
    while True:
        now = low.copy()
        np.minimum.at(now, x, low[y])
        np.minimum.at(now, y, low[x])
        now = now[now]
        if (now == low).all():
            break
        low = now
    moved = low != np.arange(len(names))
    return pd.DataFrame({"u": names[low[moved]], "v": names[moved]})


def find_duplicates(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``."""
    # pairs of long texts stand in one batch: batches are bounded by bytes, not by rows alone
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)):
        return _find_duplicates(docs, plan or Plan())


def _find_duplicates(docs: DataFrame, plan: Plan) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = write_table(signatures(docs, plan), "signatures")
    firsts = signed.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("s"))
    sets = write_table(firsts.select("f1", "f2", F.col("s.doc_id").alias("rep"), F.col("s.n").alias("n"), F.col("s.sig").alias("sig")), "sets")
    width = 4 * plan.rows
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(plan.bands)])
    members = sets.select("rep", F.posexplode(bands).alias("k", "band"))
    shared = members.groupBy("band").agg(F.min("rep").alias("center"), F.count("*").alias("size")).where("size > 1")
    buckets = write_table(members.join(shared, "band"), "buckets")
    stars = write_table(buckets.where("rep <> center").select(F.col("center").alias("u"), F.col("rep").alias("v")).distinct(), "star-pairs")
    links = write_table(_verified(stars, sets, docs, plan), "star-links")
    parts = components(links)
    more = _mixed_links(buckets, sets, parts, docs, plan)
    if more is not None:
        parts = components(links.unionByName(more))
    by_set = sets.join(parts, sets["rep"] == parts["node"], "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    joined = signed.drop("sig").join(by_set.withColumnRenamed("f1", "g1").withColumnRenamed("f2", "g2"), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") > 0), "left")
    # a document with several texts belongs to the smallest component of them
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component", "doc_id"), "doc_id"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )
