"""Phrases, token counts and whitening: awkward rows against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkspan.llm import phrases, queries, token_counts, whitening
from larkspan.session import scratch_path
from tests.llm.brute import LOWER


def plain_collocations(rows, least, percent, keep):
    """rows: (text, lang). The rows that the operator returns."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= percent * a for b in longer):
                continue
            cuts = [(2_000_000 * a // (counts[p[:c]] + counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:keep])]
    return sorted(out)


def phrase_rows():
    rnd = random.Random(5)
    words = ["The", "of", "a", "cat,", "dog", "Straße", "É", "x\x00y", "日本", " ", "end.", "mixed\tup", "new\r\nline", "-", " "]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(60))), rnd.choice(["en", "de", None, "und"])) for _ in range(60)]
    rows += [("the the the the the", "en")] * 5 + [(None, "en"), ("", None), (" \t", "fr"), (",,,.", "de")]
    return rows + [("new york city hall " * 400, "en"), ("w" * 100_000 + " of a", "en")] + rows[:6]


@pytest.mark.parametrize("every, sampled, seed", [(1, 1, 1), (3, 2, 2), (2, 50, 3), (10**9, 2, 4)])
def test_collocations(spark, every, sampled, seed):
    """Whatever the sample proposes, down to nothing at all, counts are exact."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, x, 1, "h") for i, (t, x) in enumerate(rows)], "doc_id int, text string, lang string, n int, h string").repartition(5)
    plan = phrases.Plan(least=4, keep=25, sample_every=every, sample_least=sampled, seed=seed)
    got = [tuple(r) for r in phrases.collocations(docs, plan).collect()]
    assert sorted(got) == plain_collocations(rows, 4, 80, 25)


def test_collocations_of_empty_tables(spark):
    for rows in ([], [(None, None)], [("", "en")]):
        got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"))
        assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_parts_of_long_texts_keep_every_run_once(monkeypatch, size):
    monkeypatch.setattr(phrases, "_CHUNK", size)
    texts = [t.encode() for t, _ in phrase_rows()[:30] if t]
    got = Counter()
    for tokens, starts in phrases._chunks(texts, 3):
        got.update(tuple(tokens[i : i + 4]) for i in range(starts))
    whole = [w for t in texts for w in (t + b".").translate(phrases._PLAIN).replace(b".", b" . ").split()]
    want = Counter(tuple(whole[i : i + 4]) for i in range(len(whole)))
    without_marks = lambda c: {k: v for k, v in c.items() if b"." not in k}
    assert without_marks(got) == without_marks(want)


def test_runs_of_one_hash_are_told_apart():
    runs = phrases.Runs(2, [b"a", b"b", b"c"], np.array([0, 1, 0, 2, 0, 1]), 6, np.uint64(1))
    same = np.zeros(6, np.uint64)
    at, n = runs.counted(np.array([0, 2, 4]), same, 2)
    assert dict(zip(runs.text(at, 2), n.tolist())) == {"a b": 2, "a c": 1}


def test_admission_finds_what_was_added(spark):
    h = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 2000)
    some = phrases.Admission(20).joined(spark.createDataFrame([(int(x),) for x in h[:1000]], "h bigint"))
    more = some.joined(spark.createDataFrame([(int(x),) for x in h[1000:1500]], "h bigint"))
    assert some.has(h[:1000].view(np.uint64)).all() and more.has(h[:1500].view(np.uint64)).all()
    assert more.has(h[1500:].view(np.uint64)).mean() < 0.05
    bits, words, changed, was = more.told(some)
    words = words.copy()
    words[changed] = was
    assert (words == some.words).all() and bits == 20


TEXTS = [
    None, "", " ", "plain words, plain words.", "two  spaces\n\n\tand <|endoftext|> inside", "it's l'été 12 345 naïve—dash", "x" * 50_000, "日本語   text\x1c end ",
    "<|endoftext|>", "<|end", "oftext|>", "word " * 3000, "tab\tand\r\nline   end\u0085 next", "ſ ŉ ª º ǅ ɏ.",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = str(public_tokenizers.path(name))
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    rows = [(i, t, "x", b"y", 7) for i, t in enumerate(TEXTS)] + [(100 + i, "a hot text", "x", b"y", 7) for i in range(300)]
    rows += [(5, TEXTS[5], "x", b"y", 7), (None, TEXTS[3], "x", b"y", 7), (None, None, None, None, None), (3, "another of this id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id string, digest binary, n_tokens int").repartition(7)
    store = scratch_path(spark, "counts")
    want = sorted((str(i), len((t or "").encode()), count(t or "")) for i, t, *_ in rows)
    for _ in range(2):
        got = token_counts.count_tokens(docs, path, store).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    stored = spark.read.option("recursiveFileLookup", True).parquet(store)
    assert stored.count() == len({t or "" for _, t, *_ in rows})  # one for each text; the second run encoded nothing


def test_token_counts_take_only_what_the_store_lacks(spark):
    path, store = str(public_tokenizers.path("byte_bpe_50k.json")), scratch_path(spark, "counts")
    name = token_counts.Vocabulary(path).digest()
    known = spark.sql("select unhex(sha2('told before', 256)) as digest, 99L as n_tokens")
    for _ in range(2):  # the same digest appended twice is read once
        token_counts.CountStore(spark, store).append(known, name)
    docs = spark.createDataFrame([(1, "told before"), (2, "Told  before"), (3, "new")], "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path, store).collect()}
    assert got[1] == 99 and got[2] != 99
    folded = token_counts.count_tokens(docs, path, store, normalise=lambda t: F.lower(F.regexp_replace(t, " +", " ")))
    assert {r["doc_id"]: r["n_tokens"] for r in folded.collect()} == {1: 99, 2: 99, 3: got[3]}
    assert token_counts.Vocabulary(str(public_tokenizers.path("word_bpe_49k.json"))).digest() != name
    empty = token_counts.count_tokens(docs.limit(0), path, scratch_path(spark, "counts"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "digest", "n_bytes", "n_tokens"]


def test_pieces_count_as_whole_texts():
    counter = token_counts.JsonCounter(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert counter.by_piece
    rnd = random.Random(2)
    letters = list(" \n\t\r\x0b\x1c\x85 ​́ab1.,'sé’日ªº×<") + ["<|endoftext|>", " ", "\n", "'ll", "  "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(14))) for _ in range(20_000)]
    assert counter(texts) == counter.encode(texts)


def test_op12(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: (len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 512) for i, t in docs.items()}
    got = queries.QUERIES["op12_token_counts"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == want


@pytest.mark.parametrize("width", [1, 2, 9, 33])
def test_rank_one_updates(width):
    rng = np.random.default_rng(width)
    values, vectors, whole = np.zeros(width), np.eye(width), np.zeros((width, width))
    for i in range(4 * width + 20):
        v = rng.integers(-2, 3, width) * 10.0 ** rng.integers(-3, 4)
        if i % 5 == 0:
            v = np.eye(width)[rng.integers(width)] * 2  # equal eigenvalues, untouched directions
        weight = float(rng.choice([1.0, 0.5, 1e-9]))
        values, vectors = whitening.rank_one(values, vectors, v, weight)
        whole += weight * np.outer(v, v)
        size = max(np.abs(whole).max(), 1e-300)
        assert np.abs(vectors * values @ vectors.T - whole).max() <= 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(width)).max() < 1e-12
        assert (np.diff(values) >= 0).all()


def plain_whitening(rows, components=8):
    """rows: {id: vector}. n, deviations, eigenvalues, eigenvectors, in exact arithmetic up to the covariance."""
    x = {i: [int(np.floor(1024 * float(c))) + 100_000 for c in v] for i, v in rows}
    n, width = len(x), len(next(iter(x.values())))
    sums = [sum(v[d] for v in x.values()) for d in range(width)]
    centred = {i: [Fraction(v[d] * n - sums[d], n) for d in range(width)] for i, v in x.items()}
    deviation = {i: sum((v[d] * n - sums[d]) ** 2 for d in range(width)) for i, v in x.items()}
    y = np.array([[float(c) for c in v] for v in centred.values()])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)
    return n, deviation, values[order], vectors[:, order], dict(zip(centred, y))


@pytest.mark.parametrize("block_rows, partitions", [(None, 3), (1, 2), (5, 40)])
def test_whitening(spark, block_rows, partitions):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 6)) * [3, 1, 0.5, 0.2, 0.05, 0.01] @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)] + [(1000 + i, [0.5] * 6) for i in range(120)]
    odd = [(2000, None), (2001, []), (2002, [None] + [1.0] * 5), (2003, [float("nan")] * 6), (2004, [float("-inf")] + [0.0] * 5), (2005, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, "s") for i, v in rows + odd], "vec_id bigint, embedding array<float>, n int, component string").repartition(partitions)
    model = whitening.fit(whitening.usable_rows(table), 8, block_rows=block_rows)
    got = whitening.whiten(table, model).collect()
    n, deviation, values, vectors, centred = plain_whitening(rows)
    assert len(got) == 6 * len(rows) and {r["vec_id"] for r in got} == {i for i, _ in rows}
    assert all(r["n"] == n and int(r["deviation"]) == deviation[r["vec_id"]] for r in got)
    sign = {k: np.sign(np.dot(model.kept[:, k], vectors[:, k])) for k in range(6)}
    for r in got:
        k = r["component"] - 1
        want = sign[k] * float(centred[r["vec_id"]] @ vectors[:, k]) / np.sqrt(values[k])
        assert abs(r["whitened"] - want) < 1e-8
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-10 and r["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        got = whitening.fit_and_whiten(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = [(None, [float(i), 2.0 * i, 7.0]) for i in range(5)] * 2
    got = whitening.fit_and_whiten(spark.createDataFrame(line, schema)).collect()
    assert len(got) == 10 and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    tied = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [1.0, 1.0]), (4, [2.0, 1.0])], schema)
    assert {r["vec_id"] for r in whitening.fit_and_whiten(tied).collect()} == {3, 4}


def test_deviations_beyond_64_bits():
    points = np.array([[2**40, 5], [-(2**40), 7]])
    n, sums = 10**6, [10**15, -3]
    assert whitening.deviations(points, n, sums) == [str(sum((n * int(x) - s) ** 2 for x, s in zip(row, sums))) for row in points]


def test_op13(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    n, deviation, values, _, _ = plain_whitening(rows)
    got = queries.QUERIES["op13_whitening"](spark, sf_dir).collect()
    assert len(got) == 8 * n and dict(queries.QUERIES["op13_whitening"](spark, sf_dir).dtypes)["deviation"] == "bigint"
    for r in got:
        assert r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] <= 1e-8
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
