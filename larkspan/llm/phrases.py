"""Phrase collocations by Toivonen mining.

Phrases are runs of up to ``longest`` words inside a piece of text. A phrase can only be frequent if the phrases without its last and without its
first word are, so few runs have to be counted:

1. A sample of the rows proposes phrases: those met ``sample_least`` times in it. They become bits of a filter of bounded size.
2. One pass over all rows counts the proposed phrases and their negative border: every word, and every longer run whose two shorter runs are
   proposed. Proposed phrases are counted by their words. The border, mostly runs met once or twice, is counted by hash, in a third of the space.
3. A border run that is frequent is a failure. Failures join the filter, and an expansion pass counts them by their words, and the runs that
   they bring to the border. Whether one of those is frequent shows only at the end of the pass, so the longer runs that it would bring are
   counted with it, and so on up to the longest: they are few, as what a sample misses is rare. The border is closed by one such
   pass: the shorter runs of a frequent run are frequent, so each is proposed, a failure, or new to the border, and the run
   itself is counted in one pass or the other. Two runs of one hash make a failure that is none, and a collision in the filter a proposal too many;
   both are counted by their words and found rare.

Whether a run is counted depends on the filters alone, so counts are exact whatever the sample was. The sample moves work, never results.

Text is cut into words in Arrow batches, runs are counted in numpy, and Spark adds up the counts with map-side sums, so a run that a third of all
words belong to is one row for each batch. Scores look up the counts of a phrase's parts: a part that
makes up one word in ``HOT`` belongs to a table of ``longest * HOT`` rows at most, which is broadcast, and any other part is joined.

Defined cases: null and empty texts have no words; a null language is ``und``; texts of any length are worked on in parts that overlap by the longest
phrase, so none is cut short; a word may hold any character but blanks, tabs and the marks that end a piece; repeated rows count each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.skew import top_per_group
from larkspan.session import setting, write_table

#: Parts of phrases that hold one word in HOT are broadcast.
HOT = 1000
_ENDS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"."
#: Lower case for A-Z; marks that end a piece become one mark; a tab is a blank.
_PLAIN = bytes(46 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK, _ROWS = 2 << 20, 1 << 16
_COUNTS = "lang string, k int, phrase string, h bigint, f bigint"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """``least`` occurrences make a phrase of 2 to ``longest`` words a candidate; a candidate goes if a longer one that holds it has ``percent`` of its
    occurrences; ``keep`` candidates stay for each language. One row in ``sample_every`` is sampled. The filter has 16
    bits for each proposal, two to the power of ``bits`` at most (128 MB); with more proposals than that it admits more runs than it must, up to all."""

    least: int = 30
    longest: int = 4
    percent: int = 80
    keep: int = 2000
    factor: int = 2_000_000
    sample_every: int = 8
    sample_least: int = 2
    bits: int = 30
    seed: int = 11


class Admission:
    """Hashes that may be in a set, as bits of a fixed size; what was added is always found."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), np.uint64) if words is None else words

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for shift in (0, self.bits):
            at = (h >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            out &= ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out

    def among(self, h: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Those of the ``asked`` positions whose hash is found."""
        out = np.zeros(len(h), bool)
        at = np.flatnonzero(asked)
        out[at] = self.has(h[at])
        return out

    def told(self, before: Admission | None) -> tuple:
        """What a worker needs of this filter and the one before it: the bits, and the words in which the older one differs."""
        if before is None:
            return self.bits, self.words, None, None
        changed = np.flatnonzero(self.words != before.words)
        return self.bits, self.words, changed, before.words[changed]

    def joined(self, hashes: DataFrame) -> Admission:
        """This filter and the hashes of ``hashes(h)``. Spark makes the bits; the driver receives at most one number for each word of the filter."""
        out, mask = Admission(self.bits), (1 << self.bits) - 1
        probes = F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", self.bits).bitwiseAND(mask))
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        words = hashes.select(F.explode(probes).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        got = words.toArrow()  # rows of Python objects would be thirty times as large
        out.words[:] = self.words
        out.words[got.column("word").to_numpy()] |= got.column("bits").to_numpy().view(np.uint64)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _chunks(texts: list[bytes], overlap: int) -> Iterator[tuple[list[bytes], int]]:
    """Words and piece marks of the texts, in parts of bounded size: ``(tokens, starts)``, where runs begin at the first ``starts`` tokens only;
    the tokens behind them come again in the next part."""
    carry: list[bytes] = []
    waiting, size = [], 0

    def tokens(data: bytes) -> list[bytes]:
        return data.translate(_PLAIN).replace(_MARK, b" . ").split()

    for text in texts:
        at = 0
        while at < len(text):
            end = min(len(text), at + _CHUNK)
            if end < len(text):  # a part ends where a word does
                cut = max(text.rfind(b, at, end) for b in (b" ", b"\n", b".", b"\t"))
                if cut <= at:  # a word of several parts
                    cuts = [c for c in (text.find(b, end) for b in (b" ", b"\n", b".", b"\t")) if c >= 0]
                    cut = min(cuts, default=len(text))
                end = cut
            waiting.append(text[at:end] if end < len(text) else text[at:] + _MARK)
            size += end - at
            at = end
            if size >= _CHUNK:
                found = carry + tokens(b" ".join(waiting))
                starts = max(0, len(found) - overlap)
                yield found, starts
                carry, waiting, size = found[starts:], [], 0
    found = carry + tokens(b" ".join(waiting))
    if found:
        yield found, len(found)


@dataclass
class Runs:
    """The runs of a chunk that a pass admits, by number of words."""

    longest: int
    words: list[bytes]
    codes: np.ndarray
    starts: int
    seed: np.uint64

    def __post_init__(self):
        hashed = pd.util.hash_array(np.array(self.words, dtype=object), categorize=False)
        self.hashed = _mixed(hashed ^ self.seed)[self.codes] if len(self.words) else np.zeros(0, np.uint64)
        mark = self.words.index(_MARK) if _MARK in self.words else -1
        self.word = self.codes != mark

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1 to ``longest`` words: the number, which positions begin a run, and its hash, by position."""
        n, whole, h = len(self.codes), self.word, self.hashed
        for k in range(1, self.longest + 1):
            if k > 1:
                m = n - k + 1
                if m <= 0:
                    return
                whole = whole[:m] & self.word[k - 1 :]
                h = _mixed(h[:m] * _MIX + self.hashed[k - 1 :])
            yield k, whole, h

    def counted(self, at: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One position of every distinct run among those at ``at``, and how often it is there; told apart by their words, not by hash."""
        first, n, which = _distinct(h[at], at)
        apart = np.zeros(len(at), bool)
        for j in range(k):
            apart |= self.codes[at + j] != self.codes[first[which] + j]
        if apart.any():  # two runs with one hash
            own, others = self.counted(at[~apart], h, k), self.counted(at[apart], h, k)
            return np.concatenate([own[0], others[0]]), np.concatenate([own[1], others[1]])
        return first, n

    def text(self, at: np.ndarray, k: int) -> list[str]:
        words = self.words
        return [b" ".join([words[c] for c in run]).decode("utf-8") for run in np.stack([self.codes[at + j] for j in range(k)], 1).tolist()]


def _runs(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[str, Runs]]:
    pdf = batch.to_pandas()
    for lang, own in pdf.groupby("lang", sort=True):
        seed = pd.util.hash_array(np.array([lang], dtype=object), categorize=False)[0]
        for tokens, starts in _chunks([t.encode("utf-8", "surrogatepass") for t in own["text"]], longest - 1):
            codes, words = pd.factorize(np.array(tokens, dtype=object))
            yield lang, Runs(longest, list(words), codes, starts, seed)


def _distinct(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every distinct key the first of its entries in ``at`` and its count, and for every entry which key it has."""
    which, found = pd.factorize(keys)
    first = np.zeros(len(found), at.dtype)
    first[which[::-1]] = at[::-1]
    return first, np.bincount(which, minlength=len(found)), which


def propose(rows: DataFrame, plan: Plan) -> DataFrame:
    """``h`` of the runs that a sample holds ``sample_least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, runs in _runs(batch, plan.longest):
                for _, whole, h in runs.levels():
                    own = h[: runs.starts][whole[: runs.starts]]
                    found, n, _ = _distinct(own, own)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    sample = rows.where(F.rand(plan.seed) * plan.sample_every < 1)
    found = sample.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= plan.sample_least).select("h")


def _told(lang: str | None, k: int | None, phrases: list[str] | None, h: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    same = lambda value, kind: pa.nulls(len(f), kind) if value is None else pa.array([value] * len(f), kind)
    columns = [same(lang, pa.string()), same(k, pa.int32()), pa.nulls(len(f), pa.string()) if phrases is None else pa.array(phrases, pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(h, pa.int64()), pa.array(f, pa.int64())], ["lang", "k", "phrase", "h", "f"])


def _by_words(lang: str, k: int, runs: Runs, h: np.ndarray, counted: np.ndarray) -> Iterator[pa.RecordBatch]:
    at, n = runs.counted(np.flatnonzero(counted[: runs.starts]), h, k)
    for i in range(0, len(at), _ROWS):
        part = at[i : i + _ROWS]
        yield _told(lang, k, runs.text(part, k), np.zeros(len(part), np.int64), n[i : i + _ROWS])


def count_admitted(rows: DataFrame, plan: Plan, shared: Broadcast) -> DataFrame:
    """``lang, k, phrase, h, f`` by a filter (``Admission.told``): proposed runs have their language and phrase and are counted by them, those of the border
    have their hash alone, and a row for each language with k = 0 counts all its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, _, _ = shared.value
        proposed = Admission(bits, words)
        for batch in batches:
            for lang, runs in _runs(batch, plan.longest):
                inside = None
                for k, whole, h in runs.levels():
                    m = len(whole)
                    if k == 1:
                        yield _told(lang, 0, [""], np.zeros(1, np.int64), np.array([whole[: runs.starts].sum()]))
                    admitted = whole if k == 1 else whole & inside[:m] & inside[1 : m + 1]
                    inside = proposed.among(h, admitted)
                    yield from _by_words(lang, k, runs, h, inside)
                    own = h[: runs.starts][(admitted & ~inside)[: runs.starts]]
                    found, n, _ = _distinct(own, own)
                    yield _told(None, None, None, found.view(np.int64), n)

    return rows.mapInArrow(count, _COUNTS).groupBy("lang", "k", "phrase", "h").agg(F.sum("f").alias("f"))


def count_expanded(rows: DataFrame, plan: Plan, shared: Broadcast) -> DataFrame:
    """``lang, k, phrase, h, f`` of the failures, and of what they bring to the border. Whether a run is frequent that is new to the border is not known yet; the
    runs that it would bring in turn are counted with it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, changed, was = shared.value
        now, past = Admission(bits, words), Admission(bits, words.copy())
        past.words[changed] = was
        for batch in batches:
            for lang, runs in _runs(batch, plan.longest):
                inside = outside = None
                for k, whole, h in runs.levels():
                    m = len(whole)
                    before = whole if k == 1 else whole & outside[:m] & outside[1 : m + 1]
                    admitted = whole if k == 1 else whole & inside[:m] & inside[1 : m + 1]
                    outside = past.among(h, before)
                    new = admitted & ~before
                    failed = now.among(h, before) & ~outside
                    yield from _by_words(lang, k, runs, h, new | failed)
                    inside = outside | failed | new

    return rows.mapInArrow(count, _COUNTS).groupBy("lang", "k", "phrase", "h").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, plan: Plan = Plan(), text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang, k, phrase, f`` of all phrases of 1 to ``longest`` words that occur ``least`` times, and under k = 0 the number of words of each language."""
    rows = docs.select(F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"), F.col(text_column).alias("text")).where("text is not null")
    spark = docs.sparkSession
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)):
        proposed = write_table(propose(rows, plan), "proposed")
        bits = min(max(20, (16 * proposed.count()).bit_length()), plan.bits)
        first = Admission(bits).joined(proposed)
        shared = spark.sparkContext.broadcast(first.told(None))
        found = write_table(count_admitted(rows, plan, shared).where((F.col("f") >= plan.least) | (F.col("k") == 0)), "frequent")
        shared.destroy()
        out, failures = found.where("phrase is not null"), found.where("phrase is null").select("h")
        if not failures.isEmpty():
            shared = spark.sparkContext.broadcast(first.joined(failures).told(first))
            out = out.unionByName(write_table(count_expanded(rows, plan, shared).where(F.col("f") >= plan.least), "expanded"))
            shared.destroy()
    return out.select("lang", "k", "phrase", "f")


def _looked_up(spark: SparkSession, rows: DataFrame, parts: DataFrame, hot: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``column``. Phrases that hold one word in HOT are few and broadcast; any other is a part of at most
    its count divided by ``least`` candidates, so no key of the join is large."""
    often = F.broadcast(hot.select("lang", F.col("phrase").alias(column), F.col("f").alias("often")))
    marked = rows.join(often, ["lang", column], "left")
    known = marked.where("often is not null").withColumnRenamed("often", out)
    rest = marked.where("often is null").drop("often").join(parts.select("lang", F.col("phrase").alias(column), F.col("f").alias(out)), ["lang", column])
    return known.unionByName(rest)


def _words(column: str, begin: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(column, begin, length), " ")


def collocations(docs: DataFrame, plan: Plan = Plan(), text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``keep`` phrases by score."""
    spark = docs.sparkSession
    found = write_table(frequent_phrases(docs, plan, text_column, lang_column), "phrases")
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    parts = found.where((F.col("k") > 0) & (F.col("k") < plan.longest))
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot = parts.where(F.col("f") * HOT >= total)
    candidates = found.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))

    words = F.split("phrase", " ")
    inner = F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))"))
    inside = candidates.where("k > 2").withColumn("w", words).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    alone = candidates.join(inside, ["lang", "phrase"], "left").where(f"held is null or 100 * held < {plan.percent} * a").drop("held")

    cut = alone.withColumn("w", words).select("lang", "phrase", "a", "k", "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", _words("w", 1, F.col("cut")).alias("left"), _words("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cut = _looked_up(spark, _looked_up(spark, cut, parts, hot, "left", "l"), parts, hot, "right", "r")
    score = F.expr(f"(cast({plan.factor} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low")
    scored = cut.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_per_group(scored, ["lang"], order, ["phrase"], plan.keep, "rank")
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
