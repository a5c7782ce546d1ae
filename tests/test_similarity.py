"""Similar sets against all pairs: thresholds, hot elements cut into many pieces, copies, odd rows, and how many pairs are compared."""

from __future__ import annotations

import numpy as np
import pytest

from larkspan.plans import similarity as sim

SCHEMA = "id bigint, set array<string>"


def families(seed, n, words):
    """Sets around a few bases, with a word that nearly all have."""
    rng = np.random.default_rng(seed)
    bases = [rng.choice(words, size=rng.integers(1, 40)) for _ in range(12)]
    out = []
    for i in range(n):
        base = bases[rng.integers(len(bases))]
        kept = base[rng.random(len(base)) < rng.choice([0.6, 0.9, 1.0])]
        extra = rng.choice(words, size=rng.integers(0, 6))
        hot = ["the"] if rng.random() < 0.9 else []
        out.append((i, [str(w) for w in [*kept, *extra]] + hot))
    return out


def wanted(left, right, percent):
    found = {}
    for i, a in left:
        for j, b in right:
            a_, b_ = set(a or []) - {None}, set(b or []) - {None}
            common = len(a_ & b_)
            if a_ and b_ and 100 * common >= percent * len(a_ | b_):
                found[i, j] = (common, len(a_), len(b_))
    return found


def named(result):
    pairs, left_ids, right_ids, _ = result
    rows = pairs.join(left_ids.selectExpr("id as i", "class as left_class"), "left_class").join(right_ids.selectExpr("id as j", "class as right_class"), "right_class").collect()
    assert len({(r["i"], r["j"]) for r in rows}) == len(rows)
    return {(r["i"], r["j"]): (r["common"], r["left_n"], r["right_n"]) for r in rows}


@pytest.mark.parametrize("percent, cells, meeting", [(100, 1 << 18, 4096), (80, 1 << 18, 3), (50, 7, 2), (20, 64, 5), (1, 1, 4096)])
def test_equal_to_all_pairs(spark, monkeypatch, percent, cells, meeting):
    monkeypatch.setattr(sim, "CELLS", cells)
    monkeypatch.setattr(sim, "MEETING", meeting)
    odd = [(900, None), (901, []), (902, [None]), (903, ["the", None, "the"]), (904, ["the"]), (905, ['a","b']), (906, ["a", "b"]), (907, [""])]
    left, right = families(1, 90, 150) + odd, families(2, 110, 150) + odd
    left, right = left + families(1, 90, 150)[:9], right
    left = [(k, s) for k, (_, s) in enumerate(left)]
    got = named(sim.similar_sets(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), percent))
    assert got == wanted(left, right, percent)


def test_table_with_itself(spark):
    rows = families(4, 120, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    assert named(sim.similar_sets(df, df, 70)) == wanted(rows, rows, 70)


def test_every_digest_is_kept(spark):
    """Classes whose digest begins or ends in zero bytes too: 2,000 sets of one word, each like itself only."""
    df = spark.createDataFrame([(i, [f"w{i}"]) for i in range(2_000)], SCHEMA)
    assert sim.similar_sets(df, df, 100)[0].count() == 2_000


def test_copies_meet_once(spark):
    rows = [(i, ["the", "same", "five", "common", "words"]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, left_ids, _, candidates = sim.similar_sets(df, df, 80)
    assert (pairs.count(), candidates.count(), left_ids.count()) == (1, 1, 400)


def test_few_pairs_are_compared(spark):
    """Unrelated sets that share only frequent words hardly ever meet."""
    rng = np.random.default_rng(6)
    frequent = [f"f{i}" for i in range(10)]
    rows = [(i, [*frequent, *[f"w{x}" for x in rng.integers(0, 50_000, 30)]]) for i in range(600)]
    rows += [(600 + i, [*s[:-2], "x", "y"]) for i, s in rows[:100]]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, _, _, candidates = sim.similar_sets(df, df, 80)
    n, compared = pairs.count(), candidates.count()
    assert n == len(wanted(rows, rows, 80)) >= 900
    assert compared <= 1.5 * n, (compared, n)


def test_empty_and_bounds(spark):
    some, none = spark.createDataFrame([(1, ["a"])], SCHEMA), spark.createDataFrame([], SCHEMA)
    for left, right in ((some, none), (none, some), (none, none)):
        assert sim.similar_sets(left, right, 50)[0].count() == 0
    with pytest.raises(ValueError):
        sim.similar_sets(some, some, 0)


def test_no_product_in_the_plan(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], SCHEMA)
    plan = sim.similar_sets(df, df, 50)[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_elements_of_one_side_alone_are_not_sent(spark):
    left = spark.createDataFrame([(1, ["a", "b", "c"])], "id bigint, set array<string>")
    right = spark.createDataFrame([(i, ["a", "b", "c", f"own{i}", f"also{i}"]) for i in range(50)], "id bigint, set array<string>")
    (_, ours), (_, theirs) = sim.classes(left), sim.classes(right)
    a, b = sim.frequencies(ours), sim.frequencies(theirs)
    sent = sim.prefixes(theirs, 50, a + b, b, a, "right")
    assert sent.select("h").distinct().count() <= 3 and {r["right_at"] for r in sent.collect()} <= {2, 3, 4}
    assert sim.similar_sets(left, right, 50)[0].count() == 50
