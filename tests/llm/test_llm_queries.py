"""The registered queries on the smallest tables against plain versions (those with SQL are held to it with all others), and the pipeline."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from larkspan.llm import queries
from tests.llm import brute
from tests.llm.test_others import links_of


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_all_are_registered():
    assert [k for k in queries.QUERIES if k.startswith("op")] and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_op1(spark, sf_dir, documents):
    got = queries.QUERIES["op1_minhash_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near_duplicates(documents)


def test_op3(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = queries.QUERIES["op3_bestfit_packing"](spark, sf_dir).collect()
    check_packing(got, {i: brute.token_ids(t, tokenizer) for i, t in documents.items()})


def check_packing(rows, ids, capacity=4096):
    want = {(i, p): (at, len(x[at : at + capacity]), brute.crc(x[at : at + capacity])) for i, x in ids.items() for p, at in enumerate(range(0, len(x), capacity))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert bins.setdefault(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= capacity
    assert len(bins) <= -(-sum(bins.values()) // capacity) + 1


def test_op4(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.QUERIES["op4_embedding_dedup"](spark, sf_dir).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == links_of(rows)


def test_op8(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_suffix_dedup"](spark, sf_dir).collect()}
    for i, (data, gone) in brute.repeated_bytes(documents).items():
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x))
        assert r["kept_sha256"] == brute.sha(bytes(b for b, g in zip(data, gone) if not g))


@pytest.mark.parametrize("key, column, least", [("op2_toxicity", "toxic", 0.8), ("op6_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, sf_dir, key, column, least):
    sf = sf_dir.replace("sf0.001", "sf0.1")  # enough labels to learn from
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.QUERIES[key](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    score, predicted, y = map(np.array, zip(*held))
    rank = np.argsort(np.argsort(score))
    area = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert area > least and np.mean(predicted == y) > max(np.mean(y == 0), np.mean(y == 1)) + 0.02


def test_pipeline(spark, sf_dir, documents):
    """Each stage against a plain version on what its predecessor kept; run() gives the last stage's rows."""
    from tokenizers import Tokenizer

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = documents
    scores = {r["doc_id"]: r["score"] for r in queries.QUERIES["op2_toxicity"](spark, sf_dir).collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == names
        docs = docs.cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            want = {i: t for i, t in before.items() if scores[i] < 0.5}
        elif name == "lines":
            want = {i: "\n".join(keep) for i, (_, keep) in brute.repeated_lines(before).items()}
        elif name == "near_duplicates":
            want = {i: before[i] for i, (_, c) in brute.near_duplicates(before).items() if i == c}
        else:
            want = {i: before[i] for i, (_, hit, _) in brute.benchmark_hits(before, items).items() if not hit}
        assert after == want, name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] != documents[r["doc_id"]])
        before = after
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), {i: brute.token_ids(t, tokenizer) for i, t in before.items()})


def test_stages_on_empty_and_awkward_tables(spark, sf_dir):
    clashing = ["score", "Items", "n_lines", "n_dropped", "n_words", "n_hit", "spans", "kept", "component_id", "n_shingles", "y", "line"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in clashing)
    mine = [f"mine {c}" for c in clashing]
    rows = [(1, None, None, None, None, *mine), (2, "", "en", "s", 0, *mine), (2, "", "en", "s", 0, *mine), (None, "words " * 9, None, None, None, *mine)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            got = [(r[0], r[1] or "", *r[2:]) for r in docs.collect()]  # the second stage makes an empty text of a null
            assert sorted(map(str, got)) == sorted(str((i, t or "", *rest)) for i, t, *rest in data)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(data)
