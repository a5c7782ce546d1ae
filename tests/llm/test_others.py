"""Embeddings, archives, conversations: awkward rows against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import chat_format, embedding_dedup, warc
from larkspan.llm.components import components
from larkspan.session import scratch_path
from tests.llm import brute


def links_of(rows, threshold=0.93):
    """rows: (id, vector, label). {id: (links, component)}."""
    ok = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [
        (a[0], b[0]) for n, a in enumerate(ok) for b in ok[n + 1 :]
        if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold
    ]
    part = brute.union_find([r[0] for r in rows], pairs)
    return {i: (sum(i in p for p in pairs), part[i]) for i, _, _ in rows}


def vectors(n, width=16):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, width))
    rows = []
    for i in range(n):
        v = base[rng.integers(40)] + rng.normal(size=width) * rng.choice([0.0, 0.05, 0.2, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(n + i, [float(np.float32(x)) for x in base[0] + rng.normal(size=width) * 0.02], 1) for i in range(150)]
    m = n + 150
    odd = [None, [], [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] + [1.0] * (width - 1), [None] + [1.0] * (width - 1), [1.0, 2.0], [2.0, 4.0]]
    return rows + [(m + i, v, 1) for i, v in enumerate(odd)] + [(m + 20, base[0].tolist(), None)]


SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("leaf, levels", [(1024, 6), (40, 3)])
def test_embedding_links(spark, leaf, levels):
    rows = vectors(500)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"rep": F.lit("x"), "copies": F.lit(1), "cell": F.lit(2)})
    forest = embedding_dedup.Forest(leaf=leaf, levels=levels, group_rows=300)
    got = {r["vec_id"]: r for r in embedding_dedup.find_links(table, forest).collect()}
    want = links_of(rows)
    assert len(got) == len(want) and all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    found, there = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.97 * there
    if leaf == 1024:
        assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_embeddings_with_repeated_and_missing_ids(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(3, v, 1), (3, v, 1), (2, v, 1), (3, w, 1), (None, v, 1), (9, w, 1)]
    got = embedding_dedup.find_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == [
        ("2", 2, 2), ("3", 1, 3), ("3", 2, 2), ("3", 2, 2), ("9", 1, 3), ("None", 0, None),
    ]
    assert embedding_dedup.find_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)] + [(5000, 1399), (4000, 4000)]
    links = [(a, b) if r.random() < 0.5 else (b, a) for a, b in chain + star]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = brute.union_find({n for p in links for n in p}, links)
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def pages():
    r = random.Random(2)
    long = "".join(r.choice("abcé\r\n<>日 ") for _ in range(60_000))
    rows = [(1, "http://a/ b\r\nX: y", None), (2, None, ""), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", "é" * 50), (9, "u", "é" * 50), (7, "u", "é" * 50)]
    rows += [(20, "u", long), (21, "u", long + "."), (19, "u", long), (30, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n" * 9), (31, "u", "0\r\n\r\n" * 40)]
    return rows + [(40, "u", "same row " * 30), (40, "u", "same row " * 30), (None, "u", "no id " * 40), (None, "u", "y"), (50, "u", "no id " * 40)]


@pytest.mark.parametrize("segment, chunk, per_file", [(1 << 16, 8192, 4096), (300, 7, 2)])
def test_archives(spark, segment, chunk, per_file):
    rows = [(i, u, h) if h is None or len(h) < 9000 or segment > 1000 else (i, u, h[:5000]) for i, u, h in pages()]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("name", F.lit("x")).repartition(3)
    path = scratch_path(spark, "archives")
    warc.write_archives(table, path, chunk_bytes=chunk, segment_bytes=segment, records_per_file=per_file)
    got = warc.page_facts(spark, path).collect()
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100:
            first[data] = min(first.get(data, (1, 0)), (i is None, i or 0))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first[data] != (i is None, i or 0)
        want.append((str(i), len(data), brute.sha(data), "revisit" if again else "response", first[data][1] if again else None))
    assert sorted(map(str, want)) == sorted(str((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    whole = {(r["page_id"], bytes(r["payload"])) for r in warc.read_pages(spark, path).where("payload is not null").collect()}
    assert whole <= {(i, (h or "").encode()) for i, _, h in rows}


def test_archive_pieces_may_be_cut_anywhere_and_damage_is_told():
    data = b"".join(r + warc.END for r in warc.records_of(8, "http://x/", "é".encode() * 500, "ab", None, 64, 200))
    records = list(warc.parse(data[i : i + 3] for i in range(0, len(data), 3)))
    block = b"".join(b for _, b in records)
    assert len(records) > 3 and records[-1][0]["WARC-Segment-Total-Length"] == str(len(block))
    assert warc.unframe(block) == "é".encode() * 500
    with pytest.raises(ValueError):
        list(warc.parse(iter([data[:-40]])))
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n")


def test_missing_segment_is_told(spark):
    table = spark.createDataFrame([(1, "u", "z" * 900)], "page_id bigint, url string, html string")
    path = scratch_path(spark, "archives")
    warc.write_archives(table, path, segment_bytes=200)
    cut = warc.read_archives(spark, path).where("segment <> 2")
    with pytest.raises(Exception, match="not whole"):
        warc.reassemble(cut).collect()


def test_empty_archives(spark):
    path = scratch_path(spark, "archives")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.page_facts(spark, path).count() == 0


def test_conversations(spark):
    control = "\\### User: </turn>\n<\\/turn> \\\\# ### Assistant: ok"
    rows = [
        (1, 0, "system", control), (1, 1, "user", None), (1, 2, "assistant", control * 3), (2, 0, "assistant", "early"), (2, 0, "assistant", "early"),
        (3, 1, "tool: x|\n", "odd role"), (3, None, None, "no role"), (3, 2, "assistant", ""), (None, 0, "user", "hi"), (None, 1, "assistant", "long " * 50_000),
        (4, 1, "user", "b"), (4, 1, "user", "a"), (5, 0, "user", "q"), (5, 1, "assistant", "a"), (5, 2, "user", "q"),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"t": F.lit(1), "turns": F.lit(2), "state": F.lit(3)})
    formatted = chat_format.format_conversations(table)
    back = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    full = {r["conv_id"]: r for r in formatted.collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(back) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, t) for _, r, t in turns], c
        assert back[c]["loss_text"] == "".join(t for _, r, t in turns if r == "assistant")
        assert full[c]["formatted"] == "".join(s["text"] for s in full[c]["segments"])
        assert back[c]["formatted_chars"] == len(full[c]["formatted"])
    assert {c: r["valid"] for c, r in full.items()} == {1: True, 2: False, 3: False, None: True, 4: False, 5: False}
    assert full[5]["state"] == "asked" and full[2]["state"] == "error"
    assert chat_format.format_conversations(table.where("turn > 9")).count() == 0


def test_native_operators_have_no_python_in_their_plans(spark, sf_dir):
    import io
    from contextlib import redirect_stdout

    from larkspan.llm import queries

    for key in ("op7_line_dedup", "op10_chat_format"):
        out = io.StringIO()
        with redirect_stdout(out):
            queries.QUERIES[key](spark, sf_dir).explain("formatted")
        assert not any(w in out.getvalue() for w in ("Python", "Pandas", "Arrow")), key
