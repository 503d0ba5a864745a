"""2-D neighbour-graph embedding (M6), built from Spark joins and groupBys.

1. k nearest neighbours (exact; all rows go by each block; euclidean / manhattan / cosine).
   Of equally near rows those that follow in the order of ids count first (the
   order is a ring), so that equal rows make a ring and no hub.
2. Per row: rho = distance to the nearest neighbour, sigma by a fixed
   64-step bisection so that sum_j exp(-max(0, d_ij - rho)/sigma) = log2(k+1);
   both are column expressions over the row's k distances (no UDF).
3. Edge weights exp(-max(0, d - rho)/sigma), symmetrised with the reversed
   edge: w = a + b - a*b (full outer join on the edge key).
4. Start: smallest eigenvectors of the graph's normalised Laplacian, by block power
   iteration from the principal components. A matrix-vector product is a join of the
   edges with the vectors and a groupBy; a few products go into a job, then the block
   is orthonormalised by its (3 x 3) Gram matrix.
5. Layout: rows are cut into blocks of ``block_rows`` along the first coordinate of
   the start. A job gives each block its edges, the positions of their ends and a
   pool of rows chosen by hash, and plays ``rounds_per_job`` rounds; the positions of
   other blocks' rows stand still meanwhile. An edge of weight w acts every max(w)/w
   rounds and pulls its head; each acting edge draws ``negatives`` rows of the pool by
   hash, which push it away. A row moves by the mean over its acting edges, times a
   rate that falls linearly. Positions are written to the shared folder after each
   job (rounded to 9 decimals), so a lost executor costs at most one job.
   It ends after ``n_epochs`` rounds (500 up to 10,000 rows, else 200), or when rows
   move less than ``tolerance`` in the mean.
What a task holds is a block's rows, edges and pool. Draws depend on ids and rounds
only, and sums run in order of ids: any partitioning gives the same layout.
The curve parameters (a, b) are fitted once from ``min_dist``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelens.functions.columns import to_double_array
from featurelens.operators import blocks
from featurelens.operators.positions import dense_index
from featurelens.session import ensure_code, remove_path, shared_dir

METRICS = ("euclidean", "manhattan", "cosine")


def fit_ab(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """Least-squares fit of 1 / (1 + a x^(2b)) to the target membership curve."""
    x = np.linspace(0, spread * 3, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    best = (math.inf, 1.0, 1.0)
    a_grid, b_grid = np.linspace(0.05, 5.0, 200), np.linspace(0.2, 2.0, 200)
    for _ in range(3):
        A, B = np.meshgrid(a_grid, b_grid, indexing="ij")
        pred = 1.0 / (1.0 + A[..., None] * np.power(x[None, None, :], 2 * B[..., None]))
        err = ((pred - y) ** 2).sum(axis=2)
        i, j = np.unravel_index(np.argmin(err), err.shape)
        if err[i, j] < best[0]:
            best = (float(err[i, j]), float(A[i, j]), float(B[i, j]))
        da, db = (a_grid[1] - a_grid[0]) * 2, (b_grid[1] - b_grid[0]) * 2
        a_grid = np.linspace(max(1e-3, best[1] - da), best[1] + da, 60)
        b_grid = np.linspace(max(1e-3, best[2] - db), best[2] + db, 60)
    return best[1], best[2]


def _nearer(best: dict, k: int, row: np.ndarray, nbr: np.ndarray, dist: np.ndarray) -> None:
    """Take candidates (row, nbr, dist) into the rows' ``k`` best, in the order of distance and then the ring of ids."""
    some = np.unique(row)
    r = np.concatenate([np.repeat(some, k), row])
    to, d = np.concatenate([best["nbr"][some].ravel(), nbr]), np.concatenate([best["dist"][some].ravel(), dist])
    there = np.isfinite(d)
    r, to, d = r[there], to[there], d[there]
    order = np.lexsort((to, to < best["id"][r], d, r))
    r, to, d = r[order], to[order], d[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    first = rank < k
    best["nbr"][r[first], rank[first]], best["dist"][r[first], rank[first]] = to[first], d[first]


def knn_distances(df: DataFrame, id_col: str, vec_col: str, k: int, metric: str = "euclidean",
                  block_rows: int | None = None) -> DataFrame:
    """(id, nbr, dist): the ``k`` nearest other rows (of equally near ones those whose ids follow, in a ring)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    data = df.select(F.col(id_col).cast("long").alias("_id"), to_double_array(vec_col).alias("_v")).dropna()
    both, _ = blocks.streamed(data, "_id", data.count(), block_rows)

    def rough(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        """Distances (euclidean: squared), and how far they may be off."""
        if metric == "euclidean":
            d2, error = blocks.squared(a, b)
            return (d2, error) if np.isfinite(error) else (np.nan_to_num(blocks.euclidean(a, b) ** 2, nan=np.inf), 0.0)
        if metric == "cosine":
            return 1.0 - blocks.unit_rows(a) @ blocks.unit_rows(b).T, 0.0
        out = np.empty((a.shape[0], b.shape[0]))
        for s in range(0, a.shape[0], 16):
            out[s:s + 16] = np.abs(a[s:s + 16, None, :] - b[None, :, :]).sum(axis=2)
        return out, 0.0

    def start(hosts: list[pd.DataFrame]) -> dict:
        ids = np.concatenate([p["_id"].to_numpy() for p in hosts])
        return {"id": ids, "x": np.vstack([blocks.stack(p["_v"]) for p in hosts]), "nbr": np.zeros((len(ids), k), np.int64), "dist": np.full((len(ids), k), np.inf)}

    def feed(state: dict, part: pd.DataFrame) -> None:
        y, ids, x = blocks.stack(part["_v"]), part["_id"].to_numpy(), state["x"]
        # the k nearest others are among so many nearest, the row itself (and rows of its id) included
        place = min(k + np.unique(ids, return_counts=True)[1].max() - 1, len(ids) - 1)
        step = max(1, 2_000_000 // len(y))
        for h in range(0, len(x), step):
            d, error = rough(x[h:h + step], y)
            cut = state["dist"][h:h + step, -1]
            cut = cut * cut * (1 + 1e-12) + error if metric == "euclidean" else cut
            over = d <= cut[:, None]
            if over.sum() > 4 * k * len(d):
                least = np.partition(d, place, axis=1)[:, place]
                over = d <= np.minimum(cut, least * (1 + 1e-12) + 2 * error)[:, None]
            row, col = np.nonzero(over)
            other = state["id"][row + h] != ids[col]
            row, col = row[other], col[other]
            if len(row):
                _nearer(state, k, row + h, ids[col], blocks.between(x[h:h + step], y, row, col) if metric == "euclidean" else d[row, col])

    def finish(state: dict):
        row, at = np.nonzero(np.isfinite(state["dist"]))
        yield pd.DataFrame({"_id": state["id"][row], "nbr": state["nbr"][row, at], "dist": state["dist"][row, at]})

    from pyspark.sql import Window
    cand = both.mapInPandas(lambda batches: blocks.each_block(batches, start, feed, finish), "_id long, nbr long, dist double")
    w = Window.partitionBy("_id").orderBy(F.col("dist").asc(), (F.col("nbr") < F.col("_id")).asc(), F.col("nbr").asc())
    top = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    return top.withColumnRenamed("_id", id_col)


def fuzzy_graph(knn: DataFrame, id_col: str, k: int) -> DataFrame:
    """Symmetrised membership weights (i, j, w) from (id, nbr, dist)."""
    target = math.log2(k + 1)
    per = knn.groupBy(id_col).agg(F.collect_list("dist").alias("ds"))      # k values per row
    per = per.withColumn("rho", F.array_min(F.filter("ds", lambda x: x > 0)))
    per = per.withColumn("rho", F.coalesce("rho", F.lit(0.0)))

    def psum(sig):
        return F.aggregate("ds", F.lit(0.0),
                           lambda acc, d: acc + F.exp(-F.greatest(d - F.col("rho"), F.lit(0.0)) / sig))

    init = F.struct(F.lit(0.0).alias("lo"), F.lit(1e30).alias("hi"), F.lit(1.0).alias("mid"))

    def step(acc, _i):
        s = psum(acc["mid"])
        lo = F.when(s > target, acc["lo"]).otherwise(acc["mid"])
        hi = F.when(s > target, acc["mid"]).otherwise(acc["hi"])
        mid = F.when(hi >= 1e30, acc["mid"] * 2).otherwise((lo + hi) / 2)
        return F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"))

    per = per.withColumn("sigma", F.aggregate(F.sequence(F.lit(1), F.lit(64)), init, step)["mid"])
    e = knn.join(per.select(id_col, "rho", "sigma"), id_col)
    e = e.select(F.col(id_col).alias("i"), F.col("nbr").alias("j"),
                 F.exp(-F.greatest(F.col("dist") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("a"))
    rev = e.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("a").alias("b"))
    sym = e.join(rev, ["i", "j"], "full_outer").fillna(0.0, ["a", "b"])
    return sym.select("i", "j", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))


EXACT = "decimal(38,18)"  # sums that don't depend on the order of their terms


def _exact_sum(value) -> Column:
    return F.sum(value.cast(EXACT)).cast("double")


def spectral_start(graph: DataFrame, start: DataFrame, jobs: int = 3, products: int = 4) -> DataFrame:
    """(i, x, y): eigenvectors of the largest eigenvalues of D^-1/2 W D^-1/2 but the trivial one, scaled to +-10.

    ``graph`` holds (i, j, w) in both directions, ``start`` (i, x, y). Ties in
    the spectrum (several components) give some basis of the eigenspace.
    """
    degree = graph.groupBy("i").agg(_exact_sum(F.col("w")).alias("g")).checkpoint()
    other = degree.select(F.col("i").alias("j"), F.col("g").alias("h"))
    edges = graph.join(degree, "i").join(other, "j").select("i", "j", (F.col("w") / F.sqrt(F.col("g") * F.col("h"))).alias("m")).checkpoint()
    third = (F.pmod(F.xxhash64(F.lit(1), "i"), F.lit(2001)) / 1000.0 - 1.0)
    block = start.join(degree, "i", "left").select("i", "x", "y", third.alias("z"), F.sqrt(F.coalesce("g", F.lit(0.0))).alias("t"))

    def combined(now: DataFrame, weights: np.ndarray, out=("x", "y", "z")) -> DataFrame:
        given = ("x", "y", "z", "t")
        return now.select("i", *[F.round(sum((F.col(c) * float(w) for c, w in zip(given, row)), F.lit(0.0)), 12).alias(o) for o, row in zip(out, weights)], "t")

    def gram(now: DataFrame, pairs) -> list[float]:
        return list(now.agg(*[_exact_sum(a * b).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]).first())

    def orthonormal(now: DataFrame) -> DataFrame:
        """Vectors without their share of the trivial one, orthonormal; those that add nothing become 0."""
        names = ("x", "y", "z", "t")
        columns = [F.col(c) for c in names]
        pairs = [(columns[a], columns[b]) for a in range(4) for b in range(a, 4)]
        q = np.zeros((4, 4))
        q[np.triu_indices(4)] = [v or 0.0 for v in gram(now, pairs)]
        q = q + np.triu(q, 1).T
        weights = np.eye(4)[:3]
        if q[3, 3] > 0:
            weights = weights - np.outer(q[:3, 3] / q[3, 3], np.eye(4)[3])
        kept: list[np.ndarray] = []
        for w in weights:
            length = max(float(w @ q @ w), 0.0)
            for _ in range(2):
                for k in kept:
                    w = w - (w @ q @ k) * k
            rest = float(w @ q @ w)
            kept.append(w / math.sqrt(rest) if rest > 1e-18 + 1e-12 * length else np.zeros(4))
        return combined(now, np.array(kept))

    now = orthonormal(block.checkpoint()).checkpoint()
    for _ in range(jobs):
        for _ in range(products):
            pulled = edges.join(now.select(F.col("i").alias("j"), "x", "y", "z"), "j").groupBy("i").agg(
                *[_exact_sum(F.col("m") * F.col(c)).alias(f"{c}_") for c in ("x", "y", "z")])
            # half of the product and half of the vector: no negative eigenvalue comes first
            now = now.join(pulled, "i", "left").select("i", *[((F.col(c) + F.coalesce(f"{c}_", F.lit(0.0))) / 2.0).alias(c) for c in ("x", "y", "z")], "t")
        now = orthonormal(now.checkpoint()).checkpoint()
    pulled = edges.join(now.select(F.col("i").alias("j"), *[F.col(c).alias(f"{c}_") for c in ("x", "y", "z")]), "j").join(now, "i")
    pairs = [(F.col("m") * F.col(a), F.col(f"{b}_")) for a in ("x", "y", "z") for b in ("x", "y", "z")]
    small = np.array([v or 0.0 for v in gram(pulled, pairs)]).reshape(3, 3)
    _, rotate = np.linalg.eigh((small + small.T) / 2)
    rotate = rotate[:, ::-1][:, :2]
    rotate = rotate * np.where(rotate[np.abs(rotate).argmax(axis=0), [0, 1]] < 0, -1.0, 1.0)
    found = combined(now, np.hstack([rotate.T, np.zeros((2, 1))]), ("x", "y")).checkpoint()
    scale = found.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("m")).first()["m"] or 1.0
    return found.select("i", *[F.round(F.col(c) * 10.0 / scale, 9).alias(c) for c in ("x", "y")])


def _mixed(*parts) -> np.ndarray:
    """64 uniform bits from whole numbers."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
            out = out * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(32))
    return out


def play(nodes: np.ndarray, at: np.ndarray, own: np.ndarray, heads: np.ndarray, tails: np.ndarray, every: np.ndarray, pool: np.ndarray,
         first: int, rounds: int, total: int, a: float, b: float, negatives: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions after some rounds, and how far each row went in the last one; only ``own`` rows move.

    ``heads``, ``tails`` and ``pool`` are places in ``nodes``; edges act every ``every`` rounds.
    """
    at, moved = at.copy(), np.zeros(len(at))
    for turn in range(first, first + rounds):
        acting = np.floor((turn + 1) / every) > np.floor(turn / every)
        h, t = heads[acting], tails[acting]
        if not len(h):
            continue
        away = at[h] - at[t]
        d2 = (away ** 2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            pull = np.where(d2 > 0, (-2.0 * a * b) * d2 ** (b - 1.0) / (1.0 + a * d2 ** b), 0.0)
        step = np.clip(pull[:, None] * away, -4.0, 4.0)
        sums = np.stack([np.bincount(h, weights=step[:, c], minlength=len(at)) for c in (0, 1)], axis=1)
        for s in range(negatives if len(pool) else 0):
            drawn = pool[(_mixed(seed, turn, nodes[h], nodes[t], s) % np.uint64(len(pool))).astype(np.int64)]
            away = at[h] - at[drawn]
            d2 = (away ** 2).sum(axis=1)
            push = np.where(nodes[drawn] != nodes[h], (2.0 * b) / ((0.001 + d2) * (1.0 + a * d2 ** b)), 0.0)
            step = np.clip(push[:, None] * away, -4.0, 4.0)
            sums += np.stack([np.bincount(h, weights=step[:, c], minlength=len(at)) for c in (0, 1)], axis=1)
        count = np.maximum(np.bincount(h, minlength=len(at)), 1)
        go = np.where(own[:, None], (1.0 - turn / total) * sums / count[:, None], 0.0)
        at += go
        moved = np.sqrt((go ** 2).sum(axis=1))
    return at, moved


def layout(graph: DataFrame, start: DataFrame, n_epochs: int, a: float, b: float, negatives: int = 5, seed: int = 42,
           rounds_per_job: int = 25, block_rows: int = 4_096, pool_rows: int = 2_048, tolerance: float = 1e-4) -> DataFrame:
    """(i, x, y) after the rounds of step 5; the last table stays in the shared folder, earlier ones are removed."""
    spark = graph.sparkSession
    ensure_code(spark)
    scratch = shared_dir(spark, "embed-positions")
    rows = dense_index(start, "x", out="p", tiebreak=("i",)).checkpoint()
    n = rows.count()
    blocks_n = max(1, math.ceil(n / block_rows))
    names = rows.select("i", "p")
    top = graph.agg(F.max("w").alias("w")).first()["w"] or 1.0
    block = F.expr(f"cast(h div {block_rows} as int)").alias("block")
    # edges that would not act once are left out
    edges = graph.where(F.col("w") * max(n_epochs, 1) >= top).join(names.select("i", F.col("p").alias("h")), "i").join(
        names.select(F.col("i").alias("j"), F.col("p").alias("t")), "j").select(block, "h", "t", (F.lit(top) / F.col("w")).alias("every")).checkpoint()
    needed = edges.select("block", F.col("t").alias("p")).unionByName(rows.select(F.expr(f"cast(p div {block_rows} as int)").alias("block"), "p")).distinct().checkpoint()
    now = rows.select("p", "x", "y")

    def job(first: int, rounds: int):
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            number = key[0].as_py()
            p, x, y, drawn = (right.column(c).to_numpy() for c in ("p", "x", "y", "drawn"))
            nodes, once = np.unique(p, return_index=True)
            at = np.stack([x[once], y[once]], axis=1)
            pool = np.searchsorted(nodes, np.sort(p[drawn]))
            h, t, every = (left.column(c).to_numpy() for c in ("h", "t", "every"))
            order = np.lexsort((t, h))
            own = nodes // block_rows == number
            at, moved = play(nodes, at, own, np.searchsorted(nodes, h[order]), np.searchsorted(nodes, t[order]), every[order], pool,
                             first, rounds, n_epochs, a, b, negatives, seed)
            return pa.table({"p": nodes[own], "x": at[own, 0].round(9), "y": at[own, 1].round(9), "moved": moved[own]})
        return run

    done, last = 0, None
    while done < n_epochs and n > 1:
        rounds = min(rounds_per_job, n_epochs - done)
        pool = spark.range(blocks_n * pool_rows).select(
            F.expr(f"cast(id div {pool_rows} as int)").alias("block"), F.pmod(F.xxhash64(F.lit(seed), F.lit(done), "id"), F.lit(n)).alias("p"), F.lit(True).alias("drawn"))
        wanted = needed.withColumn("drawn", F.lit(False)).unionByName(pool)
        given = wanted.join(now.select("p", "x", "y"), "p").select(F.col("block").alias("to"), "p", "x", "y", "drawn")
        moved = edges.groupBy("block").cogroup(given.groupBy("to")).applyInArrow(job(done, rounds), "p long, x double, y double, moved double")
        path = f"{scratch}/after{done + rounds}"
        moved.write.mode("overwrite").parquet(path)
        now = spark.read.schema("p long, x double, y double, moved double").parquet(path)
        if last is not None:
            remove_path(spark, last)  # superseded positions
        done, last = done + rounds, path
        if (now.agg(F.avg("moved").alias("m")).first()["m"] or 0.0) < tolerance:
            break
    return names.join(now.select("p", "x", "y"), "p").select("i", "x", "y")


def embed_2d(df: DataFrame, id_col: str, vec_col: str, n_neighbors: int = 15, min_dist: float = 0.1,
             metric: str = "euclidean", seed: int = 42, n_epochs: int | None = None, negatives: int = 5,
             rounds_per_job: int = 25, block_rows: int = 4_096, tolerance: float = 1e-4) -> DataFrame:
    """M6: (id, umap_x, umap_y); ids must be unique. ``n_epochs`` None: 500 rounds up to 10,000 rows, else 200."""
    from featurelens.operators.features import pca

    if n_neighbors is None or n_neighbors < 2:
        raise ValueError("n_neighbors must be at least 2")
    if min_dist is None or min_dist < 0:
        raise ValueError("min_dist must be >= 0")
    a, b = fit_ab(min_dist)
    k = n_neighbors - 1
    graph = fuzzy_graph(knn_distances(df, id_col, vec_col, k, metric), id_col, k).select("i", "j", F.round("w", 12).alias("w")).checkpoint()
    coords, _, _ = pca(df, k=2, keep=(id_col,), vec_col=vec_col)
    scale = coords.agg(F.max(F.greatest(F.abs("pc1"), F.abs("pc2"))).alias("m")).first()["m"] or 1.0
    start = coords.select(F.col(id_col).alias("i"), *[F.round(F.col(c) * 10.0 / scale, 6).alias(o) for c, o in (("pc1", "x"), ("pc2", "y"))]).checkpoint()
    start = spectral_start(graph, start).checkpoint()
    if n_epochs is None:
        n_epochs = 500 if start.count() <= 10_000 else 200
    found = layout(graph, start, n_epochs, a, b, negatives, seed, rounds_per_job, block_rows, tolerance=tolerance)
    return found.select(F.col("i").alias(id_col), F.col("x").alias("umap_x"), F.col("y").alias("umap_y"))
