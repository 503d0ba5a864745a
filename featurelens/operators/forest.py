"""Isolation forest (M11) on Spark.

1. Sample: each (row, tree) gets a hash uniform ``u(seed, tree, id)``; per
   tree the ``psi`` rows with the smallest ``u`` are its sample (a grouped
   window limit after a pre-filter at ~4*psi/n). The sample of a tree does
   not depend on partitioning.
2. Grow: ``groupBy(tree).applyInPandas`` - one group is one tree's sample
   (at most ``psi`` rows, a bounded group); random choices come from a
   generator seeded by (seed, tree) over id-sorted rows.
3. Score: the node table (at most trees * (2*psi - 1) rows, fixed by the
   parameters) is broadcast; a ``mapInPandas`` pass walks all trees for a
   batch of rows at once with numpy.
4. Offset: the ``contamination`` percentile of the scores (exact, bounded
   memory); ``anomaly_score = score - offset``, label -1 when below 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.operators.quantiles import exact_percentile_scalars
from featurelens.session import ensure_code

_EULER = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size long, depth int"


def avg_path(n):
    """Average path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    out = np.where(big, 2.0 * (np.log(np.where(big, n - 1, 1.0)) + _EULER) - 2.0 * (n - 1) / np.where(big, n, 1.0), out)
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int, tree: int) -> list[tuple]:
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, None)]
    while stack:
        idx, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(idx), depth])
        if parent >= 0:
            nodes[parent][4 if side == "l" else 5] = me
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            continue
        f = int(cand[rng.integers(len(cand))])
        split = float(lo[f] + rng.random() * (hi[f] - lo[f]))
        nodes[me][2], nodes[me][3] = f, split
        go_left = sub[:, f] <= split
        stack.append((idx[~go_left], depth + 1, me, "r"))
        stack.append((idx[go_left], depth + 1, me, "l"))
    return [tuple(n) for n in nodes]


def fit_forest(df: DataFrame, id_col: str, cols, n_trees: int = 200, max_samples: int = 256,
               seed: int = 42) -> tuple[DataFrame, int]:
    """Grow the forest; returns (node table, psi)."""
    ensure_code(df.sparkSession)
    cols = list(cols)
    pts = df.select(F.col(id_col).cast("long").alias("_id"),
                    F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).dropna()
    n = pts.count()
    psi = min(max_samples, n)
    keep = min(1.0, 4.0 * psi / max(n, 1))

    def draw(tree):
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, F.col("_id")), 11).cast("double") / float(1 << 53)

    # a row comes out only for the trees whose sample it may be in
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) < F.lit(keep) if keep < 1.0 else F.lit(True))
    pairs = pts.withColumn("tree", F.explode(trees)).withColumn("_u", draw(F.col("tree")))
    from pyspark.sql import Window
    w = Window.partitionBy("tree").orderBy("_u", "_id")
    sample = pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).drop("_r", "_u")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        tree = int(pdf["tree"].iloc[0])
        x = np.vstack(pdf["_x"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        rows = _grow(x, rng, max_depth, tree)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "size", "depth"])

    nodes = sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    return nodes, psi


def score_forest(df: DataFrame, id_col: str, cols, nodes: DataFrame, psi: int) -> DataFrame:
    """Raw score ``-2^(-E[h(x)] / c(psi))`` per row (lower = more anomalous)."""
    ensure_code(df.sparkSession)
    cols = list(cols)
    tab = nodes.toPandas()           # bounded: trees * (2 * psi - 1) rows
    n_trees = int(tab["tree"].max()) + 1
    width = int(tab["node"].max()) + 1
    arrays = {}
    for name, fill, dt in (("feature", -1, np.int64), ("split", 0.0, np.float64), ("left", 0, np.int64),
                           ("right", 0, np.int64), ("size", 0, np.int64), ("depth", 0, np.int64)):
        a = np.full((n_trees, width), fill, dtype=dt)
        a[tab["tree"].to_numpy(), tab["node"].to_numpy()] = tab[name].to_numpy()
        arrays[name] = a
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(arrays)
    c_psi = float(avg_path(psi))

    def score(it):
        a = bc.value
        feat, split, left, right = a["feature"], a["split"], a["left"], a["right"]
        plen = a["depth"] + avg_path(a["size"])
        trees = np.arange(feat.shape[0])
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = np.vstack(pdf["_x"].to_numpy())
            m = len(x)
            cur = np.zeros((m, len(trees)), dtype=np.int64)
            rows = np.arange(m)[:, None]
            for _ in range(feat.shape[1]):
                f = feat[trees[None, :], cur]
                leaf = f < 0
                if leaf.all():
                    break
                v = x[rows, np.where(leaf, 0, f)]
                nxt = np.where(v <= split[trees[None, :], cur], left[trees[None, :], cur], right[trees[None, :], cur])
                cur = np.where(leaf, cur, nxt)
            h = plen[trees[None, :], cur].mean(axis=1)
            yield pd.DataFrame({"_id": pdf["_id"].to_numpy(), "score": -np.power(2.0, -h / c_psi)})

    pts = df.select(F.col(id_col).cast("long").alias("_id"),
                    F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).dropna()
    return pts.mapInPandas(score, "_id long, score double").withColumnRenamed("_id", id_col)


def isolation_forest(df: DataFrame, id_col: str, cols, n_trees: int = 200, max_samples: int = 256,
                     contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """(id, raw_score, anomaly_score, outlier_label) with label -1 for anomalies.

    Rows with a null feature are left out; without any other the result is empty."""
    if df.select(*cols).dropna().isEmpty():
        return df.select(F.col(id_col).cast("long").alias(id_col), F.lit(0.0).alias("raw_score"), F.lit(0.0).alias("anomaly_score"), F.lit(1).alias("outlier_label")).limit(0)
    nodes, psi = fit_forest(df, id_col, cols, n_trees, max_samples, seed)
    scored = score_forest(df, id_col, cols, nodes, psi).checkpoint()
    offset = exact_percentile_scalars(scored, "score", [100.0 * contamination / 100.0])[0]
    anomaly = F.col("score") - F.lit(float(offset))
    return scored.select(id_col, F.col("score").alias("raw_score"), anomaly.alias("anomaly_score"),
                         F.when(anomaly < 0, F.lit(-1)).otherwise(F.lit(1)).alias("outlier_label"))
