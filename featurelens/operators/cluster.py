"""K-means with many restarts (and many k) in one scan per iteration,
choice of k, and label normalisation.

Every restart of every k is a "run" with its own centres. All runs advance
together: one ``mapInPandas`` pass assigns each point to its nearest centre
in every run and emits only per-partition partial sums (run, cluster,
count, sum, sse); a ``groupBy(run, cluster)`` finishes them. The centre table
(runs x k x d numbers) is the only thing shipped to tasks; its size is set
by the parameters, not by the data.

Initialisation is k-means++ with a distributed exponential race: the next
centre of a run is the point minimising ``-ln(u)/D^2`` where ``u`` is a hash
of (seed, run, step, id), so the choice does not depend on partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.operators.positions import dense_index
from featurelens.session import ensure_code

_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays (wrapping arithmetic)."""
    with np.errstate(over="ignore"):
        z = (x + np.uint64(0x9E3779B97F4A7C15)) & _M64
        z = ((z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)) & _M64
        z = ((z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) & _M64
        return z ^ (z >> np.uint64(31))


def uniform(seed: int, a: int, b: int, ids: np.ndarray) -> np.ndarray:
    """Deterministic uniforms in (0, 1) from (seed, a, b, id)."""
    with np.errstate(over="ignore"):
        base = _mix(np.array([seed * 1_000_003 + a * 7919 + b], dtype=np.uint64))[0]
        z = _mix(ids.astype(np.uint64) ^ base)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _points(df: DataFrame, id_col: str, cols) -> DataFrame:
    ensure_code(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("_id"),
                     F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).dropna()


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.vstack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, 0))


def _sqdist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    diff = x[:, None, :] - c[None, :, :]
    return np.einsum("ijk,ijk->ij", diff, diff)


def _init_plus_plus(pts: DataFrame, runs: list[tuple[int, int]], seed: int, d: int) -> dict:
    """k-means++ seeding of every run; returns {run: centres (k x d)}."""
    centres = {r: np.zeros((0, d)) for r in range(len(runs))}
    kmax = max(k for k, _ in runs)
    for step in range(kmax):
        active = [r for r, (k, _) in enumerate(runs) if k > step]
        snap = {r: centres[r] for r in active}

        def pick(it, snap=snap, step=step, active=active):
            for pdf in it:
                if len(pdf) == 0:
                    continue
                x = _matrix(pdf)
                ids = pdf["_id"].to_numpy()
                rows = []
                for r in active:
                    u = uniform(seed, r, step, ids)
                    if step == 0:
                        key = -np.log(u)
                    else:
                        d2 = _sqdist(x, snap[r]).min(axis=1)
                        with np.errstate(divide="ignore"):
                            key = np.where(d2 > 0, -np.log(u) / d2, np.inf)
                    i = int(np.argmin(key))
                    rows.append((r, float(key[i]), int(ids[i]), x[i].tolist()))
                yield pd.DataFrame(rows, columns=["run", "key", "_id", "_x"])

        cand = pts.mapInPandas(pick, "run int, key double, _id long, _x array<double>")
        best = cand.groupBy("run").agg(F.min_by(F.struct("_id", "_x"), F.struct("key", "_id")).alias("b")).collect()
        for row in best:
            centres[row["run"]] = np.vstack([centres[row["run"]], np.asarray(row["b"]["_x"])[None, :]])
    return centres


def _lloyd_pass(pts: DataFrame, centres: dict) -> dict:
    """One assignment pass for all runs: {run: (counts, sums, sse_total)}."""
    snap = {r: c.copy() for r, c in centres.items()}

    def partial(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = _matrix(pdf)
            rows = []
            for r, c in snap.items():
                d2 = _sqdist(x, c)
                lab = d2.argmin(axis=1)
                best = d2[np.arange(len(x)), lab]
                for j in range(c.shape[0]):
                    m = lab == j
                    if m.any():
                        rows.append((r, j, int(m.sum()), x[m].sum(axis=0).tolist(), float(best[m].sum())))
            yield pd.DataFrame(rows, columns=["run", "cl", "n", "s", "sse"])

    part = pts.mapInPandas(partial, "run int, cl int, n long, s array<double>, sse double")
    # partials are summed as DECIMAL: exact, so the merge order across partitions
    # (and task retries) cannot change a centre in its last bits
    dec = "decimal(38,12)"
    agg = part.groupBy("run", "cl").agg(
        F.sum("n").alias("n"), F.sum(F.col("sse").cast(dec)).cast("double").alias("sse"),
        F.array(*[F.sum(F.col("s")[i].cast(dec)).cast("double") for i in range(_dim(snap))]).alias("s"))
    out: dict = {}
    for row in agg.collect():
        out.setdefault(row["run"], []).append((row["cl"], row["n"], np.asarray(row["s"]), row["sse"]))
    return out


def _dim(snap: dict) -> int:
    return next(iter(snap.values())).shape[1]


def kmeans_runs(df: DataFrame, id_col: str, cols, ks, n_init: int = 12, seed: int = 42,
                max_iter: int = 300, tol: float = 1e-4):
    """Fit every (k, restart) run; return {k: (centres, inertia)} of the best restart per k."""
    cols = list(cols)
    pts = _points(df, id_col, cols).checkpoint()
    d = len(cols)
    runs = [(k, i) for k in ks for i in range(n_init)]
    var = pts.select(*[F.var_pop(F.col("_x")[i]).alias(f"v{i}") for i in range(d)]).first()
    tol_abs = tol * float(np.mean([var[f"v{i}"] or 0.0 for i in range(d)]))
    centres = _init_plus_plus(pts, runs, seed, d)
    active = set(centres)
    inertia = {r: math.inf for r in centres}
    for _ in range(max_iter):
        stats = _lloyd_pass(pts, {r: centres[r] for r in active})
        moved = set()
        for r, rows in stats.items():
            new = centres[r].copy()
            for cl, n, s, _sse in rows:
                new[cl] = s / n
            inertia[r] = sum(x[3] for x in rows)
            shift = float(((new - centres[r]) ** 2).sum())
            centres[r] = new
            if shift > tol_abs:
                moved.add(r)
        active = moved
        if not active:
            break
    final = _lloyd_pass(pts, centres)
    for r, rows in final.items():
        inertia[r] = sum(x[3] for x in rows)
    best: dict = {}
    for r, (k, i) in enumerate(runs):
        if k not in best or inertia[r] < best[k][1]:
            best[k] = (centres[r], inertia[r])
    return best, pts


def assign(pts: DataFrame, centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """Nearest-centre label for every point (centres shipped as a small array)."""
    c = np.asarray(centres, dtype=np.float64)

    def lab(it):
        for pdf in it:
            x = _matrix(pdf)
            lbl = _sqdist(x, c).argmin(axis=1) if len(pdf) else np.zeros(0, dtype=np.int64)
            yield pd.DataFrame({"_id": pdf["_id"].to_numpy(), out: lbl.astype(np.int32)})

    return pts.mapInPandas(lab, f"_id long, {out} int")


def relabel_by_first(df: DataFrame, id_col: str, label: str, noise=-1) -> DataFrame:
    """Renumber clusters 0.. in order of their smallest member id (noise kept)."""
    firsts = df.filter(F.col(label) != F.lit(noise)).groupBy(label).agg(F.min(id_col).alias("_first"))
    ranks = dense_index(firsts, "_first", out="_new").select(label, F.col("_new").cast("int").alias("_new"))
    return df.join(ranks, label, "left").withColumn(
        label, F.coalesce(F.col("_new"), F.lit(noise).cast("int"))).drop("_new")


def kmeans(df: DataFrame, id_col: str, cols, k: int = 6, n_init: int = 12, seed: int = 42) -> DataFrame:
    """M7: (id, cluster) of the best of ``n_init`` k-means++ restarts."""
    if k is None or k < 1:
        raise ValueError("k must be a positive number of clusters")
    best, pts = kmeans_runs(df, id_col, cols, [k], n_init, seed)
    labels = assign(pts, best[k][0])
    return relabel_by_first(labels, "_id", "cluster").withColumnRenamed("_id", id_col)


def optimal_k(df: DataFrame, id_col: str, cols, ks=range(2, 11), n_init: int = 12, seed: int = 42,
              measure: str = "silhouette") -> DataFrame:
    """M10 + T6: per k the silhouette, Davies-Bouldin and inertia of the best
    restart; ``best`` marks the k with the highest silhouette (first on ties).

    ``measure="silhouette_squared"`` takes the closed form, linear in the rows,
    for tables where all pairs are out of reach; the column has its name."""
    from featurelens.operators.quality import davies_bouldin, silhouette, silhouette_squared

    if measure not in ("silhouette", "silhouette_squared"):
        raise ValueError(f"no such measure: {measure}")

    ks = list(ks)
    best, pts = kmeans_runs(df, id_col, cols, ks, n_init, seed)
    labelled = pts
    for k in ks:
        labelled = labelled.join(assign(pts, best[k][0], out=f"k{k}"), "_id")
    labelled = labelled.checkpoint()
    counts = labelled.agg(*[F.count_distinct(f"k{k}").alias(f"k{k}") for k in ks]).first()
    usable = [k for k in ks if counts[f"k{k}"] >= 2]
    spark = df.sparkSession
    if not usable:
        return spark.createDataFrame([], f"k int, {measure} double, davies_bouldin double, inertia double, best boolean")
    names = [f"k{k}" for k in usable]
    judge = silhouette if measure == "silhouette" else silhouette_squared
    sil = {r["labelling"]: r[measure] for r in judge(labelled, "_id", names, "_x").collect()}
    dbi = {r["labelling"]: r["davies_bouldin"] for r in davies_bouldin(labelled, names, "_x").collect()}
    rows = []
    for k in usable:
        inertia = float(np.rint(best[k][1] * 100) / 100)
        rows.append((k, sil[f"k{k}"], dbi[f"k{k}"], inertia))
    res = spark.createDataFrame(rows, f"k int, {measure} double, davies_bouldin double, inertia double")
    top = max(rows, key=lambda r: (r[1] if r[1] is not None else -math.inf, -r[0]))[0]
    return res.withColumn("best", F.col("k") == F.lit(top))
