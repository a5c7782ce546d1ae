"""Removal of repeated passages by prefix doubling over ranked positions.

A byte goes when a string of ``length`` bytes that covers it also starts earlier. Ranks are doubled from one byte to ``GRAM`` bytes in
memory (the rank of 2k bytes at a position is made of those of k bytes there and k bytes on; ranks are 64-bit names). A row for each
byte of a corpus would be many times the corpus, so only positions that content chooses go to Spark: in each window of
``length`` bytes, those with the smallest rank. Equal windows choose equal positions, so none of their repeats is missed.

Round 1: Spark sorts (rank, rank of the surroundings that windows through this position can reach, document, position) by range, on
all four, so that no rank, however frequent, lands in one task. A rank that stands alone is dropped. An occurrence
whose surroundings already stood earlier is covered whole and done. What is left are the first occurrences of different
surroundings of one rank.
Round 2: their windows of the full length are ranked. All occurrences of one rank meet in one task, unless there are more than
``block`` of them: those are ranked by Spark at growing lengths, on what shrinking ranges of neighbouring windows have in common, until they
are unique or done; groupings are combined before their shuffle.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; rows without a doc_id come last; rows that share
a doc_id are ordered by start and by the checksum of their text, and equal rows count as one; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.session import write_table

GRAM = 32
LAST = 2**63 - 1
_rng = np.random.default_rng(5)
_BYTES = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(2**62, 2**63, 8, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def doubled_ranks(raw: np.ndarray) -> np.ndarray:
    """The rank of the ``GRAM`` bytes at each position."""
    rank, k = _BYTES[raw], 1
    for step in _STEPS:
        if k == GRAM:
            break
        rank = rank[:-k] * step + rank[k:]
        k *= 2
    rank ^= rank >> np.uint64(29)
    rank *= np.uint64(0xBF58476D1CE4E5B9)
    return rank ^ (rank >> np.uint64(32))


def _over(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of ``width`` values."""
    k = 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def chosen(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that some window of ``length`` bytes chooses, their ranks, and the ranks of their surroundings."""
    n, width = len(raw), length - GRAM + 1
    if n < length:
        none = np.empty(0, np.uint64)
        return none.astype(np.int64), none, none
    rank = doubled_ranks(raw)
    least = _over(rank, width, np.minimum)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_over(padded, width, np.maximum) == rank)
    around = np.zeros(len(at), np.uint64)
    inside = (at >= width - 1) & (at + length <= n)
    deep = at[inside]
    mixed = np.zeros(len(deep), np.uint64)
    reach = sorted({*range(1 - width, length - GRAM, GRAM), 0, length - GRAM})
    for step in reach:
        mixed = mixed * _STEPS[7] + rank[deep + step]
    around[inside] = mixed
    data = raw.tobytes()
    for i in np.flatnonzero(~inside):
        begin = max(0, at[i] - width + 1)
        around[i] = xxhash.xxh64_intdigest(data[begin : at[i] + length], int(at[i] - begin) + 1)
    return at, rank[at], around


def _packed(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _positions(docs: DataFrame, length: int) -> DataFrame:
    """h (rank), c (rank of the surroundings), d (document), pt (position and checksum of the text)."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(parts):
            at, h, c, d, mark = zip(*parts)
            n = [len(x) for x in at]
            pt = (np.concatenate(at) << 32) | np.repeat(np.array(mark, np.int64), n)
            return pd.DataFrame({"h": np.concatenate(h).view(np.int64), "c": np.concatenate(c).view(np.int64), "d": np.repeat(np.array(d, np.int64), n), "pt": pt})

        for pdf in batches:
            parts, held = [], 0
            for d, text in zip(pdf["d"], pdf["text"]):
                data = _packed(text)
                at, h, c = chosen(np.frombuffer(data, np.uint8), length)
                if len(at):
                    parts.append((at, h, c, d, zlib.crc32(data)))
                    held += len(at)
                if held > 100_000:
                    yield frame(parts)
                    parts, held = [], 0
            if parts:
                yield frame(parts)

    return docs.select("d", "text").mapInPandas(choose, "h bigint, c bigint, d bigint, pt bigint")


def _first_round(positions: DataFrame) -> DataFrame:
    """done (true: covered whole by an earlier occurrence; false: to be compared), h, d, pt. At the borders of a batch a rank may go on;
    its occurrences there are kept for comparison, which settles them."""

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            h, c, d, pt = (pdf[x].to_numpy() for x in ("h", "c", "d", "pt"))
            new_h = np.append(True, h[1:] != h[:-1])
            new_c = new_h | np.append(True, c[1:] != c[:-1])
            group = np.cumsum(new_h) - 1
            several = np.bincount(group, new_c) > 1
            several[0] = several[-1] = True
            first = np.flatnonzero(new_c)[np.cumsum(new_c) - 1]
            done = ~new_c & ((d != d[first]) | (pt != pt[first]))
            keep = done | (new_c & several[group])
            yield pd.DataFrame({"done": done[keep], "h": h[keep], "d": d[keep], "pt": pt[keep]})

    tasks = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h", "c", "d", "pt"]
    return positions.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInPandas(sift, "done boolean, h bigint, d bigint, pt bigint")


def _surroundings(docs: DataFrame, open_rows: DataFrame, length: int) -> DataFrame:
    """h, d, pt, left, bytes, crowded for each occurrence that is to be compared."""
    width = length - GRAM + 1
    asked = open_rows.groupBy("d").agg(*[F.collect_list(x).alias(x) for x in ("h", "pt", "crowded")])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = zstandard.ZstdDecompressor()
        for pdf in batches:
            h, d, pt, left, crowded, pieces = [], [], [], [], [], []
            for doc, z, hs, pts, many in zip(pdf["d"], pdf["z"], pdf["h"], pdf["pt"], pdf["crowded"]):
                data = opened.decompress(z)
                pts = np.asarray(pts, np.int64)
                mine = (pts & 0xFFFFFFFF) == zlib.crc32(data)
                at = pts[mine] >> 32
                begin = np.maximum(at - width + 1, 0)
                h.append(np.asarray(hs, np.int64)[mine])
                d.append(np.full(len(at), doc, np.int64))
                pt.append(pts[mine])
                left.append(at - begin)
                crowded.append(np.asarray(many, bool)[mine])
                pieces += [data[i:j] for i, j in zip(begin.tolist(), (at + length).tolist())]
            if pieces:
                h, d, pt, left, crowded = (np.concatenate(x) for x in (h, d, pt, left, crowded))
                yield pd.DataFrame({"h": h, "d": d, "pt": pt, "left": left, "crowded": crowded, "bytes": pieces})

    joined = docs.join(asked, "d").select("d", "z", "h", "pt", "crowded")
    return joined.mapInPandas(cut, "h bigint, d bigint, pt bigint, left int, crowded boolean, bytes binary")


def _refined(rows: DataFrame, length: int, sizes: tuple[int, ...] = (18, 5, 1)) -> list[DataFrame]:
    """Covered stretches (d, pt, lo, hi) for ranks with many occurrences. As in round 1, but on ranges of neighbouring windows that shrink to
    single ones: a range is ranked by the bytes its windows have in common and by all bytes they cover. Occurrences whose bytes stood
    earlier are done; ranges whose common bytes stand alone are dropped; first occurrences of the others go on to smaller ranges."""
    width = length - GRAM + 1
    state = rows.select("h", "d", "pt", "left", "bytes", F.lit(0).alias("lo"), F.lit(width - 1).alias("hi"))
    covered = []
    for size in sizes:

        def split(batches: Iterator[pd.DataFrame], size=size) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for h, d, pt, left, data, lo, hi in pdf[["h", "d", "pt", "left", "bytes", "lo", "hi"]].itertuples(index=False):
                    gap = width - 1 - left  # where the bytes begin on the scale of windows
                    last = gap + len(data) - length  # the last window inside the text
                    for a in range(lo, hi + 1, size):
                        b = min(a + size - 1, hi)
                        first, final = max(a, gap), min(b, last)
                        if first <= final:
                            name = xxhash.xxh64_intdigest(data[max(b - gap, 0) : a + length - gap], (h ^ (a << 8) ^ b) & 0xFFFFFFFFFFFFFFFF)
                            whole = xxhash.xxh64_intdigest(data[first - gap : final + length - gap], (first << 8) ^ final)
                            out.append((h, d, pt, left, data, a, b, first, final, name - 2**63, whole - 2**63))
                if out:
                    yield pd.DataFrame(out, columns=["h", "d", "pt", "left", "bytes", "lo", "hi", "begin", "final", "name", "whole"])

        schema = "h bigint, d bigint, pt bigint, left int, bytes binary, lo int, hi int, begin int, final int, name bigint, whole bigint"
        state = write_table(state.mapInPandas(split, schema), "ranges")
        firsts = write_table(state.groupBy("name", "whole").agg(F.min(F.struct("d", "pt")).alias("first")), "range-firsts")
        met = state.join(firsts, ["name", "whole"])
        later = (F.col("d") != F.col("first.d")) | (F.col("pt") != F.col("first.pt"))
        start = F.shiftright("pt", 32) - (width - 1)
        covered.append(met.where(later).select("d", "pt", (start + F.col("begin")).alias("lo"), (start + F.col("final") + length).alias("hi")))
        several = firsts.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
        state = met.where(~later).join(several, "name", "left_semi").drop("name", "whole", "first", "begin", "final")
    return covered


def _second_round(rows: DataFrame, groups: int, length: int) -> DataFrame:
    """Covered stretches (d, pt, lo, hi). All occurrences of a rank are in one group."""
    width = length - GRAM + 1
    size = width - 1 + length
    base = int(_STEPS[6])
    inverse = pow(base, -1, 2**64)
    power, back = np.ones(size, np.uint64), np.ones(width, np.uint64)
    for i in range(1, size):
        power[i] = np.uint64(int(power[i - 1]) * base % 2**64)
    for i in range(1, width):
        back[i] = np.uint64(int(back[i - 1]) * inverse % 2**64)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "d", "pt"], kind="stable")
        h, d, pt = (pdf[x].to_numpy(np.int64) for x in ("h", "d", "pt"))
        left = pdf["left"].to_numpy(np.int64)
        right = np.fromiter(map(len, pdf["bytes"]), np.int64, len(pdf)) - left
        lo, hi = np.full(len(pdf), size, np.int64), np.full(len(pdf), -1, np.int64)
        sums = np.zeros((len(pdf), size + 1), np.uint64)
        for i in range(0, len(pdf), 2048):
            part = slice(i, i + 2048)
            table = np.zeros((len(pdf["bytes"].iloc[part]), size), np.uint8)
            for r, (data, l) in enumerate(zip(pdf["bytes"].iloc[part], left[part])):
                table[r, width - 1 - l : width - 1 - l + len(data)] = np.frombuffer(data, np.uint8)
            np.cumsum(_BYTES[table] * power, axis=1, out=sums[part, 1:])
        own = (h.view(np.uint64) + np.uint64(1)) * _STEPS[5]
        for s in range(width):
            fits = np.flatnonzero((left >= width - 1 - s) & (right >= s + length - width + 1))
            if not len(fits):
                continue
            name = (sums[fits, s + length] - sums[fits, s]) * back[s]
            name = (name ^ (name >> np.uint64(31))) * _STEPS[4] + own[fits] + np.uint64(s)
            _, first, place = np.unique(name, return_index=True, return_inverse=True)
            first = fits[first][place]
            later = (d[fits] != d[first]) | (pt[fits] != pt[first])
            gone = fits[later]
            lo[gone], hi[gone] = np.minimum(lo[gone], s), s
        at = pt >> 32
        hit = hi >= 0
        start = at - (width - 1)
        return pd.DataFrame({"d": d[hit], "pt": pt[hit], "lo": start[hit] + lo[hit], "hi": start[hit] + hi[hit] + length})

    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("h"), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(compare, "d bigint, pt bigint, lo bigint, hi bigint")


def remove_repeats(docs: DataFrame, length: int = 100, block: int = 16_384, group: int = 16_384) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed and removed (the stretches that go, as array<struct<start, length>>)."""
    if length < 2 * GRAM:
        raise ValueError(f"passages of fewer than {2 * GRAM} bytes are not supported")
    width = length - GRAM + 1
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("d"), "text", "doc_id")

    def press(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # texts cross two joins, so they travel compressed
        packer = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "d": pdf["d"], "z": [packer.compress(_packed(t)) for t in pdf["text"]]})

    pressed = docs.mapInPandas(press, "doc_id bigint, d bigint, z binary")
    sifted = write_table(_first_round(_positions(docs, length)), "sifted-positions")
    rows = sifted.where("not done").select("h", "d", "pt")
    waiting = rows.count()
    crowded = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > block).select("h", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, "h", "left").select("h", "d", "pt", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    around = write_table(_surroundings(pressed, rows, length), "surroundings")
    found = write_table(_second_round(around.where("not crowded"), max(1, math.ceil(waiting / group)), length), "covered")
    at = F.shiftright("pt", 32)
    whole = sifted.where("done").select("d", "pt", (at - (width - 1)).alias("lo"), (at + length).alias("hi"))
    covered = whole.unionByName(found)
    for part in _refined(around.where("crowded"), length):
        covered = covered.unionByName(part)
    mark = F.col("pt").bitwiseAND(F.lit(0xFFFFFFFF))
    lists = [F.collect_list(x).alias(y) for x, y in ((mark, "mark"), (F.col("lo"), "lo"), (F.col("hi"), "hi"))]
    spans = covered.groupBy("d").agg(*lists)

    def stretches(r, data: bytes) -> tuple[list[int], list[int]]:
        """Begins and ends of the maximal runs that go."""
        if r.mark is None:
            return [], []
        mine = np.asarray(r.mark, np.int64) == zlib.crc32(data)
        lo, hi = (np.clip(np.asarray(x, np.int64)[mine], 0, len(data)) for x in (r.lo, r.hi))
        if not len(lo):
            return [], []
        order = np.argsort(lo, kind="stable")
        lo, reach = lo[order], np.maximum.accumulate(hi[order])
        new = np.append(True, lo[1:] > reach[:-1])
        return lo[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)].tolist()

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = zstandard.ZstdDecompressor()
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                out = []
                for r in pdf.iloc[i : i + 256].itertuples(index=False):
                    data = opened.decompress(r.z)
                    begins, ends = stretches(r, data)
                    kept, at = [], 0
                    for i, j in zip(begins, ends):
                        kept.append(data[at:i])
                        at = j
                    kept = b"".join([*kept, data[at:]])
                    removed = [{"start": i, "length": j - i} for i, j in zip(begins, ends)]
                    out.append((r.doc_id, kept, len(data), len(data) - len(kept), removed))
                yield pd.DataFrame(out, columns=["doc_id", "kept", "n_bytes", "n_removed", "removed"]).astype({"doc_id": "Int64"})

    schema = "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,length:bigint>>"
    return pressed.join(spans, "d", "left").select("doc_id", "z", "mark", "lo", "hi").mapInPandas(strip, schema)
