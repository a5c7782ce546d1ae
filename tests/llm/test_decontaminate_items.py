"""Benchmark items without an id, and items longer than a block."""

from __future__ import annotations

from larkspan.llm import decontaminate

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def rows_of(found):
    return {r["doc_id"]: (r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in found.collect()}


def test_items_without_an_id_hit(spark):
    a, b = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    docs = spark.createDataFrame([(1, f"x {a}"), (2, b), (3, f"{a} {b}"), (4, "x")], DOCS)
    items = spark.createDataFrame([(None, a), (7, b), (None, b)], ITEMS)
    want = {1: (10, [None], [(1, 10)]), 2: (10, ["7", None], [(0, 10)]), 3: (20, ["7", None], [(0, 20)]), 4: (0, [], [])}
    for block_words in (1_000_000, 10):
        assert rows_of(decontaminate.find_benchmark(docs, items, block_words=block_words)) == want


def test_a_block_keeps_its_bound(spark):
    words = [f"w{i}" for i in range(103)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short one"), (3, " ".join(words[:40])), (4, None)], ITEMS)
    blocks = list(decontaminate._blocks(items, 10, 5, 30))
    assert all(len(b.vocabulary) <= 30 for b in blocks)
    assert len({tuple(sorted(b.vocabulary, key=b.vocabulary.get)[i - 1] for i in w) for b in blocks for w in b.windows}) == 94 + 1
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 10])) for i in range(94)] + [(200, " ".join(words))], DOCS)
    found = rows_of(decontaminate.find_benchmark(docs, items, block_words=30))
    assert found == rows_of(decontaminate.find_benchmark(docs, items))
    assert all(found[i] == (10, ["1", "3"] if i <= 30 else ["1"], [(0, 10)]) for i in range(94)) and found[200][0] == 103
