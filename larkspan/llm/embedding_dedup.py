"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Vectors of one label and width start in one cell per tree. A cell that holds too many is split again and again: a random direction,
drawn from the cell's name, and the median of a bounded sample along it make two halves, and vectors close to the cut go to both.
How close is told by the threshold: the halves overlap by ``spill`` standard deviations of what a pair just at the threshold
differs by along a random direction, so a split parts the same few links whatever the spread of the cell. A round fits several
levels at once and sends all members through them, so a few rounds do for any size.

A cell whose vectors lie about as close together as linked pairs do is not separated by such splits: along most directions a half
would hold more than ``useful`` of its members. It is not split further, and neither is one most of whose sampled pairs link; it is
compared in pairs of blocks instead, whatever its size. A label that is such a cell as a whole is compared once, without trees.
A useful split parts some 6 % of the links at the threshold at most (an estimate for normal projections), so the deeper the trees of a label can get, the more it has.

All pairs inside a leaf are compared in double precision. A pair that shares several leaves counts only in the one with
the smallest name, which each leaf can tell from the leaf lists its members carry: so numbers of links are exact
for the pairs found, and no pair ever leaves its leaf; only sums and a spanning set of links do.

Equal vectors of one label collapse to a representative with a count first.

Defined cases: rows with a null label, a null, empty or zero vector, or one with null or non-finite components link with nothing; vectors of
different widths are not compared; rows with the same vec_id are different vectors of that name; a row without a vec_id links with nothing, has
no component and is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.components import components
from larkspan.session import write_table

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Forest:
    """``trees`` at least, more for labels of many millions; ``levels`` are fitted in a round; ``spill`` is the width of the overlap in standard
    deviations of the projected difference of a pair at the threshold; ``useful`` is the largest share of members a half may hold."""

    threshold: float = 0.93
    trees: int = 8
    leaf: int = 1024
    levels: int = 6
    spill: float = 1.0
    useful: float = 2 / 3
    sample: int = 1024
    group_rows: int = 16_384


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _directions(cell: int, nodes: int, width: int) -> np.ndarray:
    return np.random.default_rng(cell % 2**63).normal(size=(nodes, width)) / math.sqrt(width)


def _names(cell: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The name of the cell that lies at a node below another cell."""
    x = (cell.view(np.uint64) ^ (node.astype(np.uint64) * _MIX)) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) * _MIX).view(np.int64)


def _fit(forest: Forest):
    """For a sample of one cell: whether it is dense, and (cut, half width) by node; an infinite cut is no split."""
    nodes = 2**forest.levels - 1
    apart = math.sqrt(max(0.0, 2 - 2 * forest.threshold))  # distance of two unit vectors at the threshold

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, total = int(pdf["cell"].iloc[0]), int(pdf["n"].iloc[0])
        x = _unit(pdf.sort_values("rep")["embedding"])
        some = x[:256]
        linked = ((some @ some.T) >= forest.threshold).sum() - len(some)
        cut, half = np.full(nodes, np.inf), np.zeros(nodes)
        directions = _directions(cell, nodes, x.shape[1])
        p = x @ directions.T
        wide = forest.spill * apart / 2 * np.sqrt((directions * directions).mean(1))
        middle = np.median(p, 0)
        larger = np.maximum((p <= middle + wide).mean(0), (p >= middle - wide).mean(0))
        dense = len(some) > 1 and bool(linked * 2 >= len(some) * (len(some) - 1) or np.median(larger) > forest.useful)
        at = {0: np.arange(len(x))}
        for node in range(nodes):
            rows = at.get(node)
            if rows is None or (node and len(rows) * total / len(x) <= forest.leaf * 0.8):
                continue
            v = p[rows, node]
            low, high = (v <= np.median(v) + wide[node]), (v >= np.median(v) - wide[node])
            if node and max(low.mean(), high.mean()) > forest.useful:
                continue  # the next round looks at it with a full sample
            cut[node], half[node] = float(np.median(v)), float(wide[node])
            at[2 * node + 1] = rows[low]
            at[2 * node + 2] = rows[high]
        return pd.DataFrame({"cell": [cell], "dense": [dense], "cut": [cut.tolist()], "half": [half.tolist()]})

    return fit


def _route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members with the cuts of their cell to the cells below."""
    for pdf in batches:
        out = []
        for cell, at in pdf.groupby("cell").indices.items():
            part = pdf.iloc[at]
            cut, half = np.array(part["cut"].iloc[0]), np.array(part["half"].iloc[0])
            x = _unit(part["embedding"])
            p = x @ _directions(int(cell), len(cut), x.shape[1]).T
            row, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            while True:
                inner = node < len(cut)
                inner[inner] = np.isfinite(cut[node[inner]])
                if not inner.any():
                    break
                r, k = row[inner], node[inner]
                v = p[r, k]
                low, high = v <= cut[k] + half[k], v >= cut[k] - half[k]
                row = np.concatenate((row[~inner], r[low], r[high]))
                node = np.concatenate((node[~inner], 2 * k[low] + 1, 2 * k[high] + 2))
            out.append(pd.DataFrame({"cell": _names(np.full(len(row), cell, np.int64), node + 1), "rep": part["rep"].to_numpy()[row]}))
        if out:
            yield pd.concat(out)


def _trees(n: Column, forest: Forest) -> Column:
    """So many that a pair at the threshold stays together in one of them with a chance of 0.95, if every split is the worst useful one."""
    depth = F.greatest(F.log(n / forest.leaf), F.lit(0.0)) / -math.log(forest.useful)
    return F.greatest(F.lit(forest.trees), F.ceil(3 / F.pow(F.lit(0.94), depth))).cast("int")


def _leaves(vectors: DataFrame, forest: Forest) -> DataFrame:
    """cell, rep, dense, n: the leaves of all trees."""

    def fitted(large: DataFrame) -> DataFrame:
        share = F.pmod(F.xxhash64("rep", "cell"), F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000 * forest.sample)
        sampled = large.where(share).join(vectors.select("rep", "embedding"), "rep").select("cell", "n", "rep", "embedding")
        return write_table(sampled.groupBy("cell").applyInPandas(_fit(forest), "cell bigint, dense boolean, cut array<double>, half array<double>"), "cell-cuts")

    roots = write_table(vectors.select("rep", F.xxhash64("label", F.size("embedding")).alias("cell")), "roots")
    roots = roots.join(write_table(roots.groupBy("cell").agg(F.count("*").alias("n")), "root-sizes"), "cell")
    whole = fitted(roots.where(F.col("n") > forest.leaf)).where("dense").select("cell")
    found = roots.join(whole, "cell").select("cell", "rep", F.lit(True).alias("dense"), "n")
    cells = roots.join(whole, "cell", "left_anti").select("cell", "rep", F.explode(F.sequence(F.lit(1), _trees(F.col("n"), forest))).alias("tree"))
    cells = write_table(cells.select(F.xxhash64("cell", "tree").alias("cell"), "rep"), "cells")
    while True:
        sizes = write_table(cells.groupBy("cell").agg(F.count("*").alias("n")), "cell-sizes")
        found = found.unionByName(cells.join(sizes.where(F.col("n") <= forest.leaf), "cell").select("cell", "rep", F.lit(False).alias("dense"), "n"))
        if not sizes.where(F.col("n") > forest.leaf).count():
            return found
        large = cells.join(sizes.where(F.col("n") > forest.leaf), "cell")
        cuts = fitted(large)
        found = found.unionByName(large.join(cuts.where("dense"), "cell").select("cell", "rep", F.lit(True).alias("dense"), "n"))
        going = cuts.where("not dense").select("cell", "cut", "half")
        moved = cells.join(going, "cell").join(vectors.select("rep", "embedding"), "rep").select("cell", "rep", "embedding", "cut", "half")
        cells = write_table(moved.mapInPandas(_route, "cell bigint, rep bigint").distinct(), "cells")


def _compare(forest: Forest):
    """For members of whole leaves, or of a pair of blocks of a dense one: links by representative, and a spanning set of links."""

    def one(cell: int, side: np.ndarray, rep: np.ndarray, copies: np.ndarray, x: np.ndarray, lists: np.ndarray):
        m = len(rep)
        link = (x @ x.T) >= forest.threshold
        np.fill_diagonal(link, False)
        if side.any():  # two different blocks: pairs inside a block are met where the block meets itself
            link &= side[:, None] != side[None, :]
        busy = np.flatnonzero(link.any(1))
        if not len(busy):
            return
        link, rep, copies = link[np.ix_(busy, busy)], rep[busy], copies[busy]
        counted = link
        earlier = [l[l < cell] for l in lists[busy]]
        if any(len(l) for l in earlier):
            names, place = np.unique(np.concatenate(earlier), return_inverse=True)
            has = np.zeros((len(busy), len(names)), np.float32)
            has[np.repeat(np.arange(len(busy)), [len(l) for l in earlier]), place] = 1
            counted = link & ((has @ has.T) == 0)
        lowest = np.arange(len(busy))
        order = np.argsort(rep)
        rank = np.empty(len(busy), np.int64)
        rank[order] = lowest
        mark = rank.copy()
        while True:
            now = np.minimum(mark, np.where(link, mark[None, :], m).min(1))
            now = now[order][now]  # a mark is the rank of a member: take that member's mark
            if (now == mark).all():
                break
            mark = now
        yield pd.DataFrame({"rep": rep, "links": counted @ copies, "root": rep[order][mark]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        rep, copies, side = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(np.int64), pdf["side"].to_numpy(np.int64)
        lists = np.empty(len(pdf), object)
        lists[:] = [np.asarray(l, np.int64) for l in pdf["leaves"]]
        for (cell, _, _), at in pdf.groupby(["cell", "i", "j"], sort=False).indices.items():
            out += one(cell, side[at], rep[at], copies[at], _unit(pdf["embedding"].iloc[at]), lists[at])
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")

    return compare


def find_links(embeddings: DataFrame, forest: Forest | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings(vec_id, embedding, label)``."""
    forest = forest or Forest()
    rows = embeddings.select("vec_id", "embedding", "label")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    distinct = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # a vec_id may stand on several vectors, so a vertex is named by its vector
    vectors = write_table(distinct.select(F.xxhash64("label", "embedding").alias("rep"), F.col("rep").alias("vec_id"), "label", "embedding", "copies"), "vectors")
    leaves = write_table(_leaves(vectors, forest), "leaves")
    lists = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("cell")).alias("leaves"))
    blocks = F.when(F.col("dense"), F.ceil(F.col("n") / forest.leaf)).otherwise(1)
    placed = leaves.select("cell", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).alias("b"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    met = met.select("cell", "rep", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), F.when(F.col("b") > F.col("other"), 1).otherwise(0).alias("side"))
    total = met.count()
    full = met.join(lists, "rep").join(vectors.select("rep", "embedding", "copies"), "rep")
    dealt = full.withColumn("deal", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(max(1, math.ceil(total / forest.group_rows)))))
    found = write_table(dealt.groupBy("deal").applyInPandas(_compare(forest), "rep bigint, links bigint, root bigint"), "leaf-links")
    parts = components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = vectors.join(links, "rep", "left").join(parts, vectors["rep"] == parts["node"], "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    facts = facts.join(facts.groupBy("part").agg(F.min("vec_id").alias("component")), "part")
    facts = facts.select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"
    )
    joined = rows.join(facts, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & usable, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
