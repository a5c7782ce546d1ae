"""WARC archives: writing pages as segmented records, and reassembling them.

A record's block is an HTTP response whose body is framed in chunks. A block longer than ``segment_bytes`` becomes a first
segment and continuation records, which name their origin and carry a segment number; the last one carries the
total length. Of pages with equal payloads of at least ``min_revisit_bytes`` the one with the smallest page_id is written as a
response, the others as revisits without a payload.

Archives are written by Spark's own text writer, one gzip file per task and ``records_per_file`` records, in the shared folder;
records are separated by the blank lines that the format asks for. As no record is longer than a segment, no file is larger
than a bounded number of bytes. Reading takes whole files (binary source), and walks from record to record by
Content-Length, so payloads may hold anything. Whole records are decoded where they are read; only segments are grouped,
by origin.

Defined cases: null html is an empty payload; a null url writes no target; control characters in urls are percent-coded; each
row is a record, named by page_id and payload, so repeated rows are equal records: all responses, or all revisits of one with a
smaller page_id; a null page_id counts as larger than all others; an empty table gives empty archives; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.session import write_table

END = b"\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f]")
RECORD = "page_id bigint, name string, segment int, total_bytes bigint, record_type string, refers_to bigint, digest string, block binary"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line_end = body.index(b"\r\n", at)
        n = int(body[at:line_end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[line_end + 2 : line_end + 2 + n])
        if len(out[-1]) != n or body[line_end + 2 + n : line_end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = line_end + 4 + n


def unframe(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(END)
    return unchunk(body) if b"\r\nTransfer-Encoding: chunked" in head else body


def _number(x) -> str:
    return "none" if x is None or pd.isna(x) else str(int(x))


def _page(name: str | None) -> int | None:
    """The page_id in a record's name."""
    part = name[1:-1].split(":")[2] if name else "none"
    return None if part == "none" else int(part)


def _head(kind: str, length: int, fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + END


def records_of(page_id, url, payload: bytes, digest: str, refers, chunk_bytes: int, segment_bytes: int) -> Iterator[bytes]:
    """The record, or the segments, of one page, without the separating blank lines."""
    name = f"<urn:page:{_number(page_id)}:{digest}>"
    target = [] if url is None else [("WARC-Target-URI", _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))]
    common = [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _head("revisit", len(status), [("WARC-Record-ID", name), *target, profile, ("WARC-Refers-To", f"<urn:page:{refers}:{digest}>"), *common]) + status
        return
    block = status + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _head("response", len(block), [("WARC-Record-ID", name), *target, *common]) + block
        return
    starts = range(0, len(block), segment_bytes)
    for i, at in enumerate(starts, 1):
        part = block[at : at + segment_bytes]
        number = ("WARC-Segment-Number", str(i))
        if i == 1:
            fields = [("WARC-Record-ID", name), *target, *common, number]
        else:
            fields = [("WARC-Record-ID", f"{name[:-1]}:{i}>"), ("WARC-Segment-Origin-ID", name), *target, number]
            fields += [("WARC-Segment-Total-Length", str(len(block)))] if i == len(starts) else []
        yield _head("response" if i == 1 else "continuation", len(part), fields) + part


def parse(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive that comes in pieces: header fields and block."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(data, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while need(2) and held[:2] == b"\r\n":
            del held[:2]
        if not need(1):
            return
        size = 4096
        while (end := held.find(END)) < 0:
            if not need(size):
                if (end := held.find(END)) < 0:
                    raise ValueError("a record's header does not end")
                break
            size *= 2
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        if not need(end + 4 + n):
            raise ValueError("a record's block is cut short")
        yield fields, bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n]


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or several members, a piece at a time."""
    at = memoryview(content)
    while len(at):
        member = zlib.decompressobj(31)
        while len(at) and not member.eof:
            part, at = at[:step], at[step:]
            yield member.decompress(part)
            if member.eof:
                at = memoryview(member.unused_data + bytes(at)) if member.unused_data else at


def write_archives(
    pages: DataFrame, path: str, min_revisit_bytes: int = 100, chunk_bytes: int = 8192, segment_bytes: int = 1 << 16, records_per_file: int = 4096
) -> None:
    """Write ``pages(page_id, url, html)`` as archives below ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    key = [F.coalesce("page_id", F.lit(2**63 - 1)).alias("__page"), F.sha2("html", 256).alias("__digest")]
    marks = write_table(rows.where(F.octet_length("html") >= min_revisit_bytes).select(*key).distinct(), "page-digests")
    first = marks.groupBy("__digest").agg(F.min("__page").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    # the join that carries payloads is by page and digest, so a payload that many pages share is spread
    again = marks.join(first, "__digest").where(F.col("__page") > F.col("first")).select("__page", "__digest", F.col("first").alias("refers"))

    def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                out = []
                for r in pdf.iloc[i : i + 64].itertuples(index=False):
                    payload = r.html.encode("utf-8", "surrogatepass")
                    refers = None if pd.isna(r.refers) else int(r.refers)
                    out += records_of(r.page_id, r.url, payload, hashlib.sha256(payload).hexdigest(), refers, chunk_bytes, segment_bytes)
                yield pd.DataFrame({"record": out})

    met = rows.select("*", *key).join(again, ["__page", "__digest"], "left")
    # ids travel as text where they may be null, so that no large one is rounded
    met = met.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers").cast("string").alias("refers"))
    records = met.mapInPandas(frame, "record binary")
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record or segment: the fields of ``RECORD``. The block of a whole response is its decoded payload; the block of
    a segment is its raw bytes."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for pdf in batches:
            for content in pdf["content"]:
                out, held = [], 0
                for fields, block in parse(inflate(content)):
                    kind, segment = fields["WARC-Type"], fields.get("WARC-Segment-Number")
                    origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                    if kind == "response" and segment is None:
                        block = unframe(block)
                    refers = fields.get("WARC-Refers-To")
                    out.append((
                        _page(origin), origin, int(segment or 0), int(fields.get("WARC-Segment-Total-Length", 0)) or None,
                        kind, _page(refers), fields.get("WARC-Payload-Digest", "")[7:] or None, block,
                    ))
                    held += len(block)
                    if held > 1 << 22:
                        yield pd.DataFrame(out, columns=names, dtype=object)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(walk, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole payloads of segmented responses: segments in the order of their numbers, checked for gaps and total length,
    then unchunked. One page's segments meet in one row; pages are the unit of the archive."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                parts = sorted(r.parts, key=lambda p: p["segment"])
                copies = sum(p["segment"] == 1 for p in parts)
                if [p["segment"] for p in parts] != [i for i in range(1, len(parts) // max(copies, 1) + 1) for _ in range(copies)]:
                    raise ValueError(f"segments of record {r.name} are not whole")
                block = b"".join(p["block"] for p in parts[::copies])
                if len(block) != r.total_bytes:
                    raise ValueError(f"record {r.name} is not whole: it does not have its length")
                out = {"page_id": _page(r.name), "name": r.name, "digest": r.digest, "payload": unframe(block)}
                yield pd.DataFrame([out] * copies).astype({"page_id": "Int64"})

    groups = (
        records.where("segment > 0")
        .groupBy("name")
        .agg(F.max("total_bytes").alias("total_bytes"), F.max("digest").alias("digest"), F.collect_list(F.struct("segment", "block")).alias("parts"))
        .select("name", "total_bytes", "digest", "parts")
    )
    return groups.mapInPandas(join, "page_id bigint, name string, digest string, payload binary")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, name, record_type, refers_to (a page_id), digest, and payload (null for a revisit)."""
    records = read_archives(spark, path)
    whole = records.where("segment = 0").select(
        "page_id", "name", "record_type", "refers_to", "digest", F.when(F.col("record_type") == "response", F.col("block")).alias("payload")
    )
    joined = reassemble(records).select(
        "page_id", "name", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"), "digest", "payload"
    )
    return whole.unionByName(joined)


def page_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per page what the archives tell: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit takes both facts
    from the response it refers to; every payload is held against the digest in its header."""

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size, digest = [], []
            for kind, told, payload in zip(pdf["record_type"], pdf["digest"], pdf["payload"]):
                if kind == "revisit":
                    size.append(None)
                    digest.append(told)
                    continue
                size.append(len(payload))
                digest.append(hashlib.sha256(payload).hexdigest())
                if digest[-1] != told:
                    raise ValueError("a payload does not have the digest of its header")
            out = pdf[["page_id", "record_type", "refers_to"]]
            yield out.assign(payload_bytes=pd.array(size, "Int64"), payload_digest=digest)

    rows = read_pages(spark, path).mapInPandas(facts, "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string")
    rows = write_table(rows, "page-facts")
    sizes = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("__bytes"))
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "payload_digest", "left").withColumnRenamed("__bytes", "payload_bytes")
    return rows.where("record_type = 'response'").unionByName(revisits)
