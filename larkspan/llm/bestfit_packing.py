"""Packing token sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. How well pieces can be packed depends only on their lengths, so the
histogram of lengths, with at most ``capacity`` entries whatever the size of the corpus, is packed on the driver: the longest
length that is left opens a bin, a bitset subset-sum over the available lengths finds the fullest combination beside it, and
that combination is removed as many times as the counts allow. The outcome is a bounded list of patterns. Pieces then
find their places by their rank among pieces of equal length: a range partitioning by length and document
numbers them, so a length that a third of all pieces share is spread over many tasks.

Defined cases: a null or empty text is the end token alone; a document of more than ``capacity`` tokens is cut into full
pieces and a rest; repeated rows are packed each on its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.session import write_table

#: Words of these characters are the same in NFC, change case one by one, and split alike here and in the tokenizer.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u0148\u014a-\u017e]+")
#: How the tokenizer splits a plain word in lower case.
_PARTS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+|[0-9]|[^a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+"
)
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+")
_KEEP_WORDS, _KEEP_PARTS = 400_000, 300_000


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others
    in turn from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordTokens:
    """Token ids of texts, as little-endian bytes, for a byte-level tokenizer that drops white space first: the ids of a text are then
    those of its words in a row, and those of a plain word are those of its parts. What was met before is not encoded
    again; words that are not plain, and those that may hold special tokens, go through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.shown = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
            found = array("I", [t.id for t in self.model.tokenize(shown)])
            if sys.byteorder == "big":
                found.byteswap()
            ids = self.parts[part] = found.tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if len(word) < 200 and _PLAIN.fullmatch(word) and not any(t in word for t in self.special if t[0] in word):
            low = word.lower()
            return self._part(low) if _LETTERS.fullmatch(low) else b"".join([self._part(p) for p in _PARTS.findall(low)])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(self.known) > _KEEP_WORDS:
            self.known.clear()
        if len(self.parts) > _KEEP_PARTS:
            self.parts.clear()
        known, out = self.known, []
        # other white space stays inside a word and is left to the tokenizer
        for word in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self._word(word) if word else b""
            out.append(ids)
        return b"".join(out)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(times, [(length, pieces a bin)])`` that use up the counts, longest length first in each bin."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    mask = (1 << (capacity + 1)) - 1
    out = []
    while left:
        longest = next(iter(left))
        reach, steps = 1 << longest, []
        for n, c in left.items():
            if (reach >> capacity) & 1:
                break
            c -= n == longest
            before = reach
            for _ in range(min(c, (capacity - longest) // n)):
                wider = reach | ((reach << n) & mask)
                if wider == reach:
                    break
                reach = wider
            if reach != before:
                steps.append((n, before))
        total = reach.bit_length() - 1
        used = {longest: 1}
        for n, before in reversed(steps):
            while not (before >> total) & 1:
                total -= n
                used[n] = used.get(n, 0) + 1
        times = min(left[n] // m for n, m in used.items())
        out.append((times, sorted(used.items(), reverse=True)))
        for n, m in used.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
    return out


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> tuple[dict[int, np.ndarray], int]:
    """By length, rows (first rank, pieces a bin, first bin, offset in the bin), and the number of bins."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    bins = 0
    for times, used in patterns:
        offset = 0
        for n, m in used:
            table.setdefault(n, []).append((rank.get(n, 0), m, bins, offset))
            rank[n] = rank.get(n, 0) + times * m
            offset += n * m
        bins += times
    return {n: np.array(rows, np.int64) for n, rows in table.items()}, bins


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = WordTokens(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            for i in range(0, len(pdf), 200):
                part = pdf.iloc[i : i + 200]
                rows = []
                for doc_id, text in zip(part["doc_id"], part["text"]):
                    ids = encoder.encode(text or "") + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        body = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(body) // 4, zlib.crc32(body), *([np.frombuffer(body, "<i4")] if with_ids else [])))
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(cut, schema)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Adds part (the task) and rank (within part and length); parts follow each other in the order of length."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", "doc_id", "piece", "ids_crc32"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for pdf in batches:
            if not len(pdf):
                continue
            length = pdf["length"].to_numpy()
            first = np.flatnonzero(np.append(True, length[1:] != length[:-1]))
            rank = np.arange(len(length)) - np.repeat(first, np.diff(np.append(first, len(length))))
            if length[0] == last:
                rank[: first[1] if len(first) > 1 else len(length)] += seen
            last, seen = length[-1], rank[-1] + 1
            yield pdf.assign(part=part, rank=rank)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", part int, rank bigint"
    return pieces.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInPandas(count, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    pieces = write_table(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    numbered = write_table(_numbered(pieces), "numbered-pieces")
    # one row for each part and length met there: as many as there are parts and lengths together
    sizes = numbered.groupBy("part", "length").count().collect()
    counts: dict[int, int] = {}
    before: dict[int, tuple[list[int], list[int]]] = {}
    for r in sorted(sizes, key=lambda r: (r["length"], r["part"])):
        parts, firsts = before.setdefault(r["length"], ([], []))
        parts.append(r["part"])
        firsts.append(counts.get(r["length"], 0))
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    table, _ = places(minimum_bin_slack(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast((table, before))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, before = shared.value
        for pdf in batches:
            length, part, rank = (pdf[c].to_numpy(np.int64) for c in ("length", "part", "rank"))
            sequence, offset = np.empty_like(length), np.empty_like(length)
            key = length * (1 << 31) + part
            for k in np.unique(key):
                at = np.flatnonzero(key == k)
                n, p = divmod(int(k), 1 << 31)
                parts, firsts = before[n]
                r = rank[at] + firsts[bisect_right(parts, p) - 1]
                rows = table[n]
                row = rows[np.searchsorted(rows[:, 0], r, "right") - 1]
                turn, slot = np.divmod(r - row[:, 0], row[:, 1])
                sequence[at], offset[at] = row[:, 2] + turn, row[:, 3] + slot * n
            yield pdf.drop(columns=["part", "rank"]).assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return numbered.mapInPandas(place, schema)
