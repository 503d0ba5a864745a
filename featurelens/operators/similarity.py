"""Cosine similarity: one-to-all search, all-rows kNN, centroid
representatives and collection diversity.

* one-to-all (J4): the query vector is a single row, fetched as a literal
  array; every row's similarity is a JVM expression; the top-N is a
  ``TakeOrderedAndProject``. No join at all.
* all-rows kNN (J8 exact): blocked cells (``blocks.py``), numpy per cell,
  per-row top-k merged with a grouped window limit.
* ranking uses the similarity itself; differences below 1e-12 (the order of a
  floating-point sum) are ties. Only what is returned is rounded.
* diversity (A19): closed form over unit vectors, one aggregate, no pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.functions.columns import cosine, dot, norm, rnd, to_double_array
from featurelens.operators import blocks
from featurelens.operators.sizes import broadcast_if_small

TIE_DECIMALS = 12


def query_vector(df: DataFrame, id_col: str, vec_col: str, query_id) -> list | None:
    """The vector of one row (a bounded, single-row fetch)."""
    row = df.filter(F.col(id_col) == F.lit(query_id)).select(to_double_array(vec_col).alias("v")).limit(1).collect()
    return None if not row else [float(x) for x in row[0]["v"]]


def similar_to(df: DataFrame, id_col: str, vec_col: str, query_id, n: int = 5, zero_norm: float = 0.0,
               keep=()) -> DataFrame:
    """The ``n`` rows most cosine-similar to ``query_id``; the
    query row scores -2 (so it ranks last); ties by id ascending."""
    q = query_vector(df, id_col, vec_col, query_id)
    if q is None:
        return df.limit(0).select(F.lit(0).alias("rank"), F.col(id_col), F.lit(0.0).alias("similarity"), *keep)
    qv = F.array(*[F.lit(x) for x in q])
    sim = F.when(F.col(id_col) == F.lit(query_id), F.lit(-2.0)) \
        .otherwise(cosine(to_double_array(vec_col), qv, zero_norm))
    scored = df.select(F.col(id_col), *keep, sim.alias("similarity")).withColumn("_key", rnd("similarity", TIE_DECIMALS))
    top = scored.orderBy(F.col("_key").desc(), F.col(id_col).asc()).limit(n)
    w = Window.orderBy(F.col("_key").desc(), F.col(id_col).asc())
    return top.withColumn("rank", F.row_number().over(w)).withColumn("similarity", rnd("similarity", 6)).drop("_key")


def knn_all(df: DataFrame, id_col: str, vec_col: str, k: int = 5, block_rows: int = blocks.DEFAULT_BLOCK_ROWS,
            zero_norm: float = 0.0) -> DataFrame:
    """Exact k nearest neighbours (cosine) of every row: (id, rank, nbr, similarity).

    Ranking key: similarity (desc), then neighbour id.
    """
    data = df.select(F.col(id_col).cast("long").alias("_id"), to_double_array(vec_col).alias("_v")) \
        .filter(F.col("_v").isNotNull())
    n = data.count()
    cells, nb = blocks.with_cells(data, "_id", n, block_rows)

    def per_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = blocks.split_cell(pdf, nb)
        out = []
        pairs = [(left, right)] if same else [(left, right), (right, left)]
        for a, b in pairs:
            if len(a) == 0 or len(b) == 0:
                continue
            ua, ub = blocks.unit_rows(blocks.stack(a["_v"])), blocks.unit_rows(blocks.stack(b["_v"]))
            sim = ua @ ub.T
            za = (ua * ua).sum(axis=1) == 0
            zb = (ub * ub).sum(axis=1) == 0
            sim[za, :] = zero_norm
            sim[:, zb] = zero_norm
            sim = blocks.rounded(sim, TIE_DECIMALS)
            ida, idb = a["_id"].to_numpy(), b["_id"].to_numpy()
            sim[ida[:, None] == idb[None, :]] = -np.inf       # never your own neighbour
            kk = min(k, len(b))
            # order by (-sim, nbr id): lexsort on the id first, then similarity
            order = np.argsort(idb, kind="stable")
            s_sorted = sim[:, order]
            top = np.argsort(-s_sorted, axis=1, kind="stable")[:, :kk]
            vals = np.take_along_axis(s_sorted, top, axis=1).ravel()
            keep = np.isfinite(vals)
            out.append(pd.DataFrame({"_id": np.repeat(ida, kk)[keep], "nbr": idb[order][top].ravel()[keep],
                                     "similarity": vals[keep]}))
        if not out:
            return pd.DataFrame({"_id": pd.Series(dtype="int64"), "nbr": pd.Series(dtype="int64"),
                                 "similarity": pd.Series(dtype="float64")})
        return pd.concat(out, ignore_index=True)

    cand = cells.groupBy("_cell").applyInPandas(per_cell, "_id long, nbr long, similarity double")
    w = Window.partitionBy("_id").orderBy(F.col("similarity").desc(), F.col("nbr").asc())
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select(F.col("_id").alias(id_col), "rank", "nbr", rnd("similarity", 6).alias("similarity"))


def centroids(df: DataFrame, group: str, vec_col: str) -> DataFrame:
    """Mean vector per group: (group, centroid ARRAY<DOUBLE>, size).

    Per-dimension averages are a partial aggregate on (group, dim); the
    re-assembled arrays have one entry per dimension (bounded by the width).
    """
    ex = df.select(group, F.posexplode(to_double_array(vec_col)).alias("_i", "_x"))
    per_dim = ex.groupBy(group, "_i").agg(F.avg("_x").alias("_m"))
    arr = per_dim.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_c"))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return arr.select(group, F.transform("_c", lambda s: s["_m"]).alias("centroid")).join(sizes, group)


def representatives(df: DataFrame, group: str, id_col: str, vec_col: str, noise=-1) -> DataFrame:
    """Per group the row most cosine-similar to the group mean (first id
    on ties), the group size and the similarity (3 decimals); noise skipped."""
    data = df.filter(F.col(group) != F.lit(noise)) if noise is not None else df
    cents = broadcast_if_small(centroids(data, group, vec_col), "centroid")
    j = data.select(group, id_col, to_double_array(vec_col).alias("_v")).join(cents, group)
    sim = rnd(cosine(F.col("_v"), F.col("centroid")), TIE_DECIMALS)
    scored = j.select(group, id_col, "size", sim.alias("sim"))
    best = scored.groupBy(group).agg(
        F.max_by(F.struct(F.col(id_col), F.col("sim")), F.struct(F.col("sim"), -F.col(id_col))).alias("b"),
        F.first("size").alias("cluster_size"))
    return best.select(F.col(group).alias("cluster"), F.col("b").getField(id_col).alias("representative"),
                       "cluster_size", rnd(F.col("b.sim"), 3).alias("similarity_to_centroid"))


def diversity(df: DataFrame, vec_col: str, decimals: int = 4) -> DataFrame:
    """Mean pairwise cosine distance in closed form:
    ``1 - (|sum u|^2 - sum |u|^2) / (n (n-1))`` over unit vectors ``u``."""
    v = to_double_array(vec_col)
    nv = norm(v)
    u = F.when(nv == 0, F.transform(v, lambda x: x * 0.0)).otherwise(F.transform(v, lambda x: x / nv))
    units = df.select(u.alias("u")).filter(F.col("u").isNotNull())
    # |sum u|^2: per-dimension sums (partial aggregate), then their squares
    s2 = (units.select(F.posexplode("u").alias("_i", "_x")).groupBy("_i").agg(F.sum("_x").alias("s"))
          .agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("s2")))
    tot = units.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(dot("u", "u")), F.lit(0.0)).alias("t"))
    n = F.col("n")
    val = F.when(n < 2, F.lit(0.0)).otherwise(F.lit(1.0) - (F.col("s2") - F.col("t")) / (n * (n - 1)))
    return tot.select("n", s2.scalar().alias("s2"), "t").select("n", rnd(val, decimals).alias("diversity"))
