"""Bisecting tree (M9): top-down clusters whose cost is linear in the rows.

All leaves of a level are split in two at once. A split starts at the leaf's
mean, one standard deviation to both sides along its widest dimension, and is
refined by 2-means rounds. A round is one pass: a row finds its leaf by
descending the tree (nodes are shipped, at most 2k - 1 centres) and its side,
and a task emits only sums for (leaf, side), which are added by dimension.
Leaves are split in order of their sum of squares while there is room for k.

Coordinates are rounded to whole multiples of a power of two (24 bits of the
largest), so all sums are exact integers: neither partitioning nor a task run
twice changes a label.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions.columns import to_double_array
from featurelens.operators import blocks
from featurelens.operators.cluster import relabel_by_first
from featurelens.session import ensure_code

BITS = 24
_HALF = 24  # squares are summed in two halves of this many bits


class _Tree:
    """Nodes in order of creation; ``left`` is -1 for leaves, the right child follows the left one."""

    def __init__(self, centre: np.ndarray):
        self.centres, self.left = centre[None, :], np.array([-1])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            rows = np.flatnonzero(self.left[at] >= 0)
            if not len(rows):
                return at
            first = self.left[at[rows]]
            at[rows] = first + _nearer_second(x[rows], self.centres[first], self.centres[first + 1])

    def split(self, leaf: int, pair: np.ndarray) -> None:
        self.left[leaf] = len(self.left)
        self.centres, self.left = np.vstack([self.centres, pair]), np.concatenate([self.left, [-1, -1]])


def _nearer_second(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 where ``b`` is nearer than ``a``, else 0."""
    return (((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)).astype(np.int64)


def _whole(pdf: pd.DataFrame, scale: float) -> np.ndarray:
    return np.rint(blocks.stack(pdf["_v"]) * scale)


def _sums(rows: DataFrame, tree: _Tree, pairs: dict, scale: float, d: int) -> dict:
    """{(leaf, side): (n, sums, sums of squares)} of the leaves in ``pairs`` (of the root if there is none)."""
    leaves = np.array(sorted(pairs) or [0])
    split = bool(pairs)
    both = np.stack([pairs[i] for i in leaves]) if split else None

    def partial(batches):
        n = np.zeros((len(leaves), 2), np.int64)
        s, high, low = (np.zeros((len(leaves), 2, d), np.int64) for _ in range(3))
        for pdf in batches:
            if not len(pdf):
                continue
            x = _whole(pdf, scale)
            at = tree.leaf_of(x)
            place = np.minimum(np.searchsorted(leaves, at), len(leaves) - 1)
            here = leaves[place] == at
            x, place = x[here], place[here]
            side = _nearer_second(x, both[place, 0], both[place, 1]) if split else np.zeros(len(x), np.int64)
            whole = x.astype(np.int64)
            np.add.at(n, (place, side), 1)
            np.add.at(s, (place, side), whole)
            np.add.at(high, (place, side), (whole * whole) >> _HALF)
            np.add.at(low, (place, side), (whole * whole) & ((1 << _HALF) - 1))
        for i, j in zip(*np.nonzero(n)):
            yield pd.DataFrame({"leaf": [int(leaves[i])], "side": [int(j)], "n": [int(n[i, j])], "s": [s[i, j]], "high": [high[i, j]], "low": [low[i, j]]})

    parts = rows.mapInPandas(partial, "leaf int, side int, n long, s array<long>, high array<long>, low array<long>")
    long = parts.select("leaf", "side", "n", F.posexplode(F.arrays_zip("s", "high", "low")).alias("i", "e")).select("leaf", "side", "i", "n", "e.*")
    added = long.groupBy("leaf", "side", "i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "high", "low")])
    out: dict = {}
    for r in added.collect():  # 2 k d rows at most
        n, s, q = out.setdefault((r["leaf"], r["side"]), [r["n"], [0] * d, [0] * d])
        s[r["i"]], q[r["i"]] = r["s"], (r["high"] << _HALF) + r["low"]
    return out


def _squares(stat) -> list[int]:
    """n^2 times the variance of every dimension, exact."""
    n, s, q = stat
    return [n * b - a * a for a, b in zip(s, q)]


def _seeds(stat) -> np.ndarray:
    n, s, _ = stat
    spread = _squares(stat)
    widest = max(range(len(spread)), key=lambda i: (spread[i], -i))
    mean = np.array([a / n for a in s])
    step = np.zeros(len(s))
    step[widest] = math.sqrt(spread[widest]) / n
    return np.stack([mean - step, mean + step])


def _grow(rows: DataFrame, k: int, max_iter: int, scale: float, d: int):
    """The tree, and of every node its parent, statistics and level."""
    root = _sums(rows, _Tree(np.zeros(d)), {}, scale, d)[0, 0]
    tree = _Tree(np.array([a / root[0] for a in root[1]]))
    nodes = [(-1, root, 0)]
    level = 0
    while True:
        level += 1
        leaves = [i for i in range(len(nodes)) if tree.left[i] < 0]
        cost = {i: sum(_squares(nodes[i][1])) / nodes[i][1][0] for i in leaves}
        order = sorted((i for i in leaves if cost[i] > 0), key=lambda i: (-cost[i], i))[:k - len(leaves)]
        if not order:
            return tree, nodes
        pairs, settled = {i: _seeds(nodes[i][1]) for i in order}, {}
        for turn in range(max_iter):
            stats = _sums(rows, tree, pairs, scale, d)
            for i in list(pairs):
                sides = [stats.get((i, j)) for j in (0, 1)]
                if None in sides:  # a side ran empty: the last split with two stays
                    pairs.pop(i)
                    continue
                settled[i] = (pairs[i], sides)
                means = np.stack([np.array([a / n for a in s]) for n, s, _ in sides])
                if np.array_equal(means, pairs[i]):
                    pairs.pop(i)
                else:
                    pairs[i] = means
            if not pairs:
                break
        if not settled:
            return tree, nodes
        for i in sorted(settled):
            tree.split(i, settled[i][0])
            nodes += [(i, side, level) for side in settled[i][1]]


def bisecting_tree(df: DataFrame, id_col: str, vec_col: str, k: int, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """Labels (id, cluster) of at most ``k`` clusters, and the tree's nodes (node, parent, level, n, sse, leaf).

    Clusters are numbered by their smallest id. Fewer than k come out where
    there are fewer distinct vectors. ``max_iter`` is the number of rounds a
    level may take. Ids are distinct whole numbers; rows with a null id, a
    null vector or an entry that is null or not finite are left out; all
    vectors have the same width. An empty table gives two empty results.
    """
    if k < 1 or max_iter < 1:
        raise ValueError(f"k and max_iter must be positive: {k}, {max_iter}")
    spark = df.sparkSession
    ensure_code(spark)
    usable = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), to_double_array(vec_col).alias("_v")).where("_id IS NOT NULL")
    rows = rows.where(F.coalesce(usable, F.lit(False))).checkpoint()
    extent = rows.agg(F.max(F.array_max(F.transform("_v", F.abs))).alias("top"), F.max(F.size("_v")).alias("d")).first()
    node_schema = "node int, parent int, level int, n long, sse double, leaf boolean"
    if not extent["d"]:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).alias("cluster")), spark.createDataFrame([], node_schema)
    top = extent["top"] or 1.0
    scale, d = 2.0 ** (BITS - math.frexp(top)[1]), extent["d"]
    tree, nodes = _grow(rows, k, max_iter, scale, d)

    def label(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"_id": pdf["_id"], "cluster": tree.leaf_of(_whole(pdf, scale)).astype(np.int32)})

    labels = relabel_by_first(rows.mapInPandas(label, "_id long, cluster int"), "_id", "cluster").withColumnRenamed("_id", id_col)
    table = [(i, None if parent < 0 else int(parent), level, int(stat[0]), float(sum(_squares(stat)) / stat[0] / scale ** 2), bool(tree.left[i] < 0))
             for i, (parent, stat, level) in enumerate(nodes)]
    return labels, spark.createDataFrame(table, node_schema)
