"""Operators over documents: awkward rows, empty tables, clashing columns, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import bestfit_packing, decontaminate, line_dedup, minhash_dedup, quality, queries, suffix_dedup, toxicity
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward():
    """{id: text}: nulls, empty and very long texts, exact and near copies, odd characters, repeated runs."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7)))
    base = [word() for _ in range(120)]
    line = "A common Line that many documents share"
    docs = {1: None, 2: "", 3: "   \t ", 4: "one two", 5: "one  TWO", 6: "\n\n", 7: "a" * 700, 8: "ab " * 300, 9: "\x1c \x85   日本語 İ ſ <|endoftext|> Don't"}
    docs |= {10: " ".join(base), 11: " ".join(base).upper(), 12: " ".join(base), 13: " ".join(base[:60] + [word()] + base[60:]), 14: " ".join(base[:118])}
    for i in range(20, 60):
        edit = list(base)
        for _ in range(r.randint(0, 4)):
            edit[r.randrange(120)] = word()
        docs[i] = " ".join(edit)
    for i in range(60, 75):
        docs[i] = "\n".join([line + " \t", " ".join(word() for _ in range(30)), "  " + line.upper(), "short", " ".join(base[20:50])])
    docs[80] = "\n".join(" ".join(word() for _ in range(12)) for _ in range(3000))
    docs[81] = docs[80][5000:90000] + line
    return docs


@pytest.fixture(scope="module")
def texts():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def clashing(docs, *names):
    """The table with further columns that are called like an operator's own."""
    return docs.withColumns({n: F.lit("x") for n in names})


def test_near_duplicates(docs, texts):
    got = {r["doc_id"]: r for r in minhash_dedup.find_duplicates(clashing(docs, "rep", "sig", "n", "component", "u", "v")).collect()}
    want = brute.near_duplicates(texts)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())


def test_near_duplicates_at_other_thresholds_and_small_blocks(spark, docs, texts, monkeypatch):
    full = minhash_dedup._mixed_links
    monkeypatch.setattr(minhash_dedup, "_mixed_links", lambda *a: full(*a, outside=2, inside=3))
    for percent in (70, 92, 97):
        plan = minhash_dedup.Plan(percent=percent, rows=4)
        got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.find_duplicates(docs, plan).collect()}
        assert got == {i: c for i, (_, c) in brute.near_duplicates(texts, percent).items()}


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (2, "other words in here now"), (None, text), (7, text), (2, text)]
    got = minhash_dedup.find_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 6
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(5, 2, False), (2, 2, True), (None, None, True), (7, 2, False)}


def test_spanning_links():
    u, v = np.array([5, 7, 9, 1]), np.array([7, 9, 5, 2])
    out = minhash_dedup.spanning(u, v)
    assert sorted(zip(out["u"], out["v"])) == [(1, 2), (5, 7), (5, 9)]
    assert len(minhash_dedup.spanning(np.empty(0, np.int64), np.empty(0, np.int64))) == 0


def test_repeated_lines(docs, texts):
    got = line_dedup.drop_repeated_lines(clashing(docs, "n_dropped", "__gone", "h1"), batches=3)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "h1", "n_lines", "n_dropped"]
    want = brute.repeated_lines(texts)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == {
        i: (len(lines), len(lines) - len(keep), "\n".join(keep)) for i, (lines, keep) in want.items()
    }


def test_repeated_lines_with_repeated_and_missing_ids(spark):
    line = "this line is surely long enough"
    rows = [(1, line), (1, line + "\nx"), (2, "y\n" + line), (None, line), (3, line), (3, line + "\n" + line)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got) == sorted(
        [("1", 1, 1, ""), ("1", 2, 1, "x"), ("2", 2, 1, "y"), ("None", 1, 1, ""), ("3", 1, 0, line), ("3", 2, 0, line + "\n" + line)]
    )


def test_runs_are_compacted_and_removed(spark):
    runs = line_dedup.Runs(spark, fan_in=2)
    for i in range(5):
        runs.add(runs.write(spark.range(i * 10, i * 10 + 10).select(F.col("id").alias("h1"), F.lit(0).alias("h2"))))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(r["h1"] for name in runs.names() for r in spark.table(name).collect()) == list(range(50))
    runs.forget(runs.names())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


@pytest.mark.parametrize("block", [16_384, 2])
def test_repeated_passages(docs, texts, block):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(clashing(docs, "d", "z", "pt", "mark"), block=block).collect()}
    for i, (data, gone) in brute.repeated_bytes(texts).items():
        r = got[i]
        assert bytes(r["kept"]) == bytes(b for b, g in zip(data, gone) if not g), i
        runs = bytes(gone).split(b"\0")
        assert (r["n_bytes"], r["n_removed"], len(r["removed"])) == (len(data), sum(gone), sum(1 for x in runs if x)), i
        assert all(all(gone[s["start"] : s["start"] + s["length"]]) for s in r["removed"])


def test_repeated_passages_with_repeated_and_missing_ids(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(180))
    rows = [(4, text), (4, text), (9, "x" + text), (None, text)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("4", 0), ("4", 0), ("9", 180), ("None", 180)]


def test_benchmark(spark, docs, texts):
    items = {1: texts[10][:200], 2: "one two", 3: None, 4: "", 5: "!!", 6: texts[80][7000:7300], 7: "common line THAT many documents share", 8: texts[10][:200]}
    table = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    want = brute.benchmark_hits(texts, items)
    for options in ({}, {"block_words": 20}, {"shingle": 3}):
        found = decontaminate.find_benchmark(clashing(docs, "items", "n_hit", "words"), table, **options)
        assert found.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "words"]
        for r in found.collect():
            w, hit, ids = want[r["doc_id"]]
            assert (r["n_words"], r["n_hit"], set(r["items"])) == (len(w), len(hit), ids), r["doc_id"]
            assert {p for s in r["spans"] for p in range(s["start"], s["start"] + s["length"])} == hit
    none = decontaminate.find_benchmark(docs, table.where("item_id > 99")).collect()
    assert len(none) == len(texts) and all(r["n_hit"] == 0 and r["n_words"] == len(want[r["doc_id"]][0]) for r in none)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(docs, texts, tokenizer, capacity):
    rows = bestfit_packing.pack(clashing(docs, "piece", "part", "rank"), queries.tokenizer_path(), capacity, with_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(got.get(r["doc_id"], [])) and r["length"] == len(r["ids"]) and r["ids_crc32"] == brute.crc(r["ids"])
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == {i: brute.token_ids(t, tokenizer) for i, t in texts.items()}
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // capacity) * 1.1 + 1


def test_tokens_of_odd_texts(tokenizer):
    words = bestfit_packing.WordTokens(queries.tokenizer_path())
    odd = ["'s's'LL x'd", "é à Å ſ İ ŉ Σας", "<|startoftext|>a <|endoftext|", "１２ ² ٣ a1b2", "\x00\x1f\x7f", "🤷‍♂️🤷‍♂️ " * 3, "_a__b_", "x" * 5000, "\xa0 　z"]
    for text in odd:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_slack_is_as_small_as_can_be():
    assert bestfit_packing.minimum_bin_slack({}, 10) == []
    patterns = bestfit_packing.minimum_bin_slack({7: 2, 3: 2, 6: 1, 2: 2, 10: 3}, 10)
    assert sum(t for t, _ in patterns) == 6 and all(sum(n * m for n, m in used) == 10 for _, used in patterns)
    rng = random.Random(1)
    counts = {rng.randint(1, 500): rng.randint(1, 12) for _ in range(150)}
    patterns = bestfit_packing.minimum_bin_slack(counts, 500)
    used = {}
    for t, parts in patterns:
        assert sum(n * m for n, m in parts) <= 500
        for n, m in parts:
            used[n] = used.get(n, 0) + t * m
    assert used == counts
    bins: list[int] = []  # first fit, longest first
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= n), None)
        if at is None:
            bins.append(500 - n)
        else:
            bins[at] -= n
    assert sum(t for t, _ in patterns) <= len(bins)


def labelled(spark, column, make):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        y = int(r.random() < 0.3)
        rows.append((i, make(r, y), "en", "s", 0))
        labels.append((i, y if i % 7 else None))
    rows += [(600, None, None, None, None), (601, "", None, None, None), (602, "12 34 !!", None, None, None), (None, "idiot " * 9, None, None, None)]
    both = spark.createDataFrame(labels + labels[:50] + [(None, 1)], f"doc_id bigint, {column} int")
    return spark.createDataFrame(rows, SCHEMA), both, dict(labels)


def test_toxicity(spark):
    common = ["river", "stone", "garden", "window", "table", "paper", "bread", "cloud", "music", "letter"]

    def make(r, y):
        words = [r.choice(common) + r.choice(["", "s", "ed"]) for _ in range(r.randint(20, 60))]
        for _ in range(2 * y):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "idi0t", "idiots", "moron", "morons", "Idioot", "mmoron"]))
        return " ".join(words)

    docs, labels, truth = labelled(spark, "toxic", make)
    model = toxicity.train_on(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(clashing(docs, "score"), model).collect()}
    assert len(got) == 604 and all(0 <= s <= 1 for s in got.values())
    assert got[600] == got[601] == model.prior and got[None] > 0.5
    right = [(got[i] >= 0.5) == bool(y) for i, y in truth.items() if y is not None]
    assert np.mean(right) > 0.95
    assert model.score(toxicity.buckets("river stone idiiots garden")) > model.score(toxicity.buckets("river stone gardens garden"))
    assert toxicity.train_on(docs, labels.where("toxic > 5")).score(toxicity.buckets("idiot")) < 1e-6


def test_quality(spark):
    def make(r, y):
        words = [r.choice(["the", "river", "stone", "and", "garden"]) for _ in range(r.randint(20, 60))]
        return " ".join(words) + "." if y else " ".join(w + r.choice(["###", "%%", "$$"]) for w in words)

    docs, labels, truth = labelled(spark, "quality", make)
    stats = quality.document_statistics(clashing(docs, "stats"))
    forest = quality.train_on(stats, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(stats, forest).collect()}
    assert len(got) == 604 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, y in truth.items() if y is not None]) > 0.97
    assert quality.train(np.empty((0, len(quality.STATS))), np.empty(0)).score(np.zeros((2, len(quality.STATS)))).max() < 1e-6
    assert all(len(quality.statistics(t)) == len(quality.STATS) and np.isfinite(quality.statistics(t)).all() for t in awkward().values())


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.train(x, y, trees=20, depth=3)
    scores = forest.score(x)
    for i in range(0, 500, 50):
        z = forest.start
        for feature, cut, value in zip(forest.feature, forest.cut, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[i, feature[node]] > cut[node])
            z += value[node - len(feature)]
        assert abs(scores[i] - 1 / (1 + np.exp(-z))) < 1e-12
    assert np.mean((scores > 0.5) == (y > 0.5)) > 0.9


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert minhash_dedup.find_duplicates(empty).count() == 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert decontaminate.find_benchmark(empty, items).count() == 0
    assert bestfit_packing.pack(empty, queries.tokenizer_path()).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.train_on(empty, labels)).count() == 0
    stats = quality.document_statistics(empty)
    assert quality.score_quality(stats, quality.train_on(stats, labels)).count() == 0
