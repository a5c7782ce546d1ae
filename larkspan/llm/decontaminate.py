"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``window`` consecutive words, or the whole item when it is shorter. A document that
contains a window contains every shingle of it, so of a window's shingles, ordered by rarity over all documents, the first
one is the necessary prefix: only documents that hold it can match. A shingle found at a word position gives the one
place where its window could start; places outside the document are dropped by length, the others are compared word by word.

The benchmark is taken in blocks of at most ``block_words`` words (or one window); a longer item goes in parts that overlap by a window less a word. A block's index is broadcast (its size is thereby bounded),
and all documents pass by it inside Arrow batches, without a shuffle; further blocks follow in the same job.

Defined cases: null and empty texts have no words; an item without words is ignored; items without an id hit like others and
are one null in ``items``; repeated items and
documents count row by row; extra columns of the documents are kept unless they bear the name of a result; an empty benchmark
hits nothing; an empty table of documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.session import write_table

#: Lower case for A-Z, a space for every other ASCII character that is neither a digit nor a letter.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def shingle_codes(ids: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit code per run of k word numbers; runs are verified word by word later."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    code = np.full(n, k, np.uint64)
    for j in range(k):
        code = (code ^ ids[j : j + n].astype(np.uint64)) * _MIX
        code ^= code >> np.uint64(29)
    return code


class Index:
    """Windows of one block of items. ``rank`` gives the rarity of a shingle; None before it is known."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        self.items = [name for name, _ in items]
        for i, (_, words) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for j in range(len(ids) - size + 1):
                windows.setdefault(tuple(ids[j : j + size]), set()).add(i)
        self.windows = [np.array(w, np.int32) for w in windows]
        self.holders = [sorted(x) for x in windows.values()]
        self.k = [min(shingle, len(w)) for w in self.windows]
        self.sizes = sorted(set(self.k))
        self.codes = np.unique(np.concatenate([shingle_codes(w, k) for w, k in zip(self.windows, self.k)])) if windows else np.empty(0, np.uint64)
        self.prefix: np.ndarray = np.empty(0, np.uint64)

    def order(self, frequency: dict[int, int]) -> None:
        """Pick each window's rarest shingle; entries with the same code stand next to each other."""
        entries = []
        for w, (ids, k) in enumerate(zip(self.windows, self.k)):
            codes = shingle_codes(ids, k).tolist()
            at = min(range(len(codes)), key=lambda j: (frequency.get(codes[j], 0), codes[j], j))
            entries.append((codes[at], w, at))
        entries.sort()
        self.entry_code = np.array([e[0] for e in entries], np.uint64)
        self.entry_window = np.array([e[1] for e in entries], np.int64)
        self.entry_at = np.array([e[2] for e in entries], np.int64)
        self.prefix, self.first = np.unique(self.entry_code, return_index=True)
        self.count = np.diff(np.append(self.first, len(entries)))
        self.length = np.array([len(w) for w in self.windows], np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int32, len(words))

    def _at(self, ids: np.ndarray, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose shingle is in the sorted table, and its place there."""
        none = np.empty(0, np.int64)
        known = ids > 0
        if len(ids) < k or not len(table) or not known.any():
            return none, none
        run = np.convolve(known, np.ones(k, np.int64), "valid") == k
        where = np.flatnonzero(run)
        if not len(where):
            return none, none
        codes = shingle_codes(ids, k)[where]
        place = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        ok = table[place] == codes
        return where[ok], place[ok]

    def shingles_in(self, ids: np.ndarray) -> np.ndarray:
        found = [self._at(ids, self.codes, k)[1] for k in self.sizes]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of verified windows, and the window at each."""
        starts, which = [], []
        for k in self.sizes:
            where, place = self._at(ids, self.prefix, k)
            for i in range(0, len(where), 50_000):
                w, p = where[i : i + 50_000], place[i : i + 50_000]
                n = self.count[p]
                entry = np.repeat(self.first[p] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                start, window = np.repeat(w, n) - self.entry_at[entry], self.entry_window[entry]
                ok = (start >= 0) & (start + self.length[window] <= len(ids))
                start, window = start[ok], window[ok]
                for size in np.unique(self.length[window]):
                    part = self.length[window] == size
                    s, x = start[part], window[part]
                    same = np.ones(len(s), bool)
                    table = np.stack([self.windows[v] for v in x]) if len(x) else np.empty((0, size), np.int32)
                    for j in range(size):
                        same &= ids[s + j] == table[:, j]
                    starts.append(s[same])
                    which.append(x[same])
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(which)


def _blocks(benchmark: DataFrame, window: int, shingle: int, block_words: int) -> Iterator[Index]:
    """The benchmark streams through the driver; one block of it is held at a time."""
    items: list[tuple[str | None, list[bytes]]] = []
    held, most = 0, max(block_words, window)
    for row in benchmark.select(F.col("item_id").cast("string").alias("id"), "text").toLocalIterator():
        words = words_of(row["text"])
        for first in range(0, max(len(words) - window + 1, min(len(words), 1)), most - window + 1):
            part = words[first : first + most]
            if items and held + len(part) > most:
                yield Index(items, window, shingle)
                items, held = [], 0
            items.append((row["id"], part))
            held += len(part)
    if items:
        yield Index(items, window, shingle)


def _rarity(docs: DataFrame, index: Index) -> dict[int, int]:
    """In how many documents each shingle of the block stands; the result is no larger than the block."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        total = np.zeros(len(index.codes), np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                total[index.shingles_in(index.numbers(words_of(text)))] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"place": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    return {int(index.codes[r["place"]]): r["n"] for r in rows}


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, block_words: int = 1_000_000
) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside a window of an item), items (ids of the items that occur, as
    array<string>) and spans (hit stretches as array<struct<start, length>> in words)."""
    added = ("n_words", "n_hit", "items", "spans")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in added])
    marks = "array<struct<start:bigint,length:bigint>>"
    spark = docs.sparkSession
    out = docs.select(
        "*", F.lit(None).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"),
        F.array().cast("array<string>").alias("items"), F.array().cast(marks).alias("spans"),
    )
    schema, blocks = out.schema, 0
    for index in _blocks(benchmark, window, shingle, block_words):
        index.order(_rarity(docs, index))
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in batches:
                n_words, n_hit, items, spans = [], [], [], []
                for text, names, old in zip(pdf["text"], pdf["items"], pdf["spans"]):
                    words = words_of(text)
                    start, which = index.find(index.numbers(words))
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + index.length[which], -1)
                    for span in old:
                        cover[span["start"]] += 1
                        cover[span["start"] + span["length"]] -= 1
                    hit = np.concatenate(([False], np.cumsum(cover) > 0))
                    edge = np.flatnonzero(hit[1:] != hit[:-1])
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    found = {*names, *(index.items[i] for w in np.unique(which) for i in index.holders[w])}
                    items.append(sorted(found, key=lambda name: (name is None, name or "")))
                    spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                yield pdf.assign(n_words=n_words, n_hit=n_hit, items=items, spans=spans)

        out = out.mapInPandas(search, schema)
        blocks += 1
        if blocks % 8 == 0:
            out = write_table(out, "decontaminate")
    if not blocks:

        def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(n_words=[len(words_of(t)) for t in pdf["text"]])

        out = out.mapInPandas(count_words, schema)
    return out
