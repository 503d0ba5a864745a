"""Agglomerative clustering (M9): ward / average / complete / single.

1. Summary on Spark: rows are summed up in weighted micro-clusters
   ``(size, centroid)``, which the caller names (``micro_col``) or k-means
   makes (``micro_clusters`` of them).
2. Merging the summary (as many rows as that parameter says) in one task: the
   nearest-neighbour chain algorithm with Lance-Williams updates (all four
   linkages are reducible, so sorting the chain's merges by height gives the
   greedy dendrogram); the k-1 highest merges are cut.
3. Labels: micro-cluster -> cluster is a table of the summary's size joined back
   to the rows on the micro-cluster id; clusters are renumbered by their
   smallest member id.

``linkage_rows`` clusters the rows themselves, without any summary:

* ``ward_rows``: reciprocal nearest clusters merge in checkpointed Spark rounds on
  ``(n, mean)``, which is all that Ward's distance needs.
* ``single_rows``: minimum spanning tree. Points are cut into tiles; a tile's own tree
  and the trees of pairs of near tiles hold every edge of it. These few edges are
  reduced by Boruvka rounds, the last of them in one task. The k - 1 longest edges
  are cut.
* ``pair_rows`` (average, complete): reciprocal nearest clusters merge in rounds; both
  linkages are reducible, so these are merges of the greedy tree. The nearest cluster
  is looked for among those whose means are near enough by bounds, and measured on
  the points of both clusters; no table of all pairs is kept. The distances of the
  last ``one_task`` clusters are summed up from blocks of points, each pair of points
  once, and merged in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.operators import blocks
from featurelens.operators import cluster as km
from featurelens.operators.density import connected_components
from featurelens.operators.positions import dense_index
from featurelens.operators.tiles import gaps, meeting, tiled
from featurelens.session import remove_path, shared_dir, stored

LINKAGES = ("ward", "average", "complete", "single")
ONE_TASK = 1000  # clusters whose remaining merges are made in one task, with the same result
TREE_ROWS = 512  # points of a tile of the spanning tree
FEW_EDGES = 200_000  # edges that one task sorts or joins


def _initial(centroids: np.ndarray, sizes: np.ndarray, linkage: str) -> np.ndarray:
    diff = centroids[:, None, :] - centroids[None, :, :]
    d2 = np.einsum("ijk,ijk->ij", diff, diff)
    if linkage == "ward":
        w = 2.0 * sizes[:, None] * sizes[None, :] / (sizes[:, None] + sizes[None, :])
        return w * d2                       # squared ward distance
    return np.sqrt(d2)


def merge_tree(centroids: np.ndarray, sizes: np.ndarray, linkage: str = "ward", distances: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """All merges ``(a, b, height)`` in creation order: the i-th merge creates
    dendrogram id ``L + i``; ``a``/``b`` are leaf ids (< L) or earlier merges.
    ``distances`` (squared for ward) stand for those between the centroids."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    n = len(sizes)
    if n < 2:
        return []
    dist = _initial(np.asarray(centroids, float), np.asarray(sizes, float), linkage) if distances is None else distances.copy()
    np.fill_diagonal(dist, np.inf)
    size = np.asarray(sizes, float).copy()
    alive = np.ones(n, bool)
    ident = np.arange(n)                    # dendrogram id currently held by each slot
    merges = []
    chain: list[int] = []
    next_id = n
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        row = np.where(alive, dist[a], np.inf)
        row[a] = np.inf
        b = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain.pop()
            chain.pop()
            h = dist[a, b]
            na, nb = size[a], size[b]
            ks = np.flatnonzero(alive)
            ks = ks[(ks != a) & (ks != b)]
            nk, dka, dkb = size[ks], dist[ks, a], dist[ks, b]
            if linkage == "ward":
                v = ((nk + na) * dka + (nk + nb) * dkb - nk * h) / (nk + na + nb)
            elif linkage == "average":
                v = (na * dka + nb * dkb) / (na + nb)
            elif linkage == "complete":
                v = np.maximum(dka, dkb)
            else:
                v = np.minimum(dka, dkb)
            dist[ks, a] = v
            dist[a, ks] = v
            alive[b] = False
            dist[b, :] = np.inf
            dist[:, b] = np.inf
            size[a] = na + nb
            height = float(np.sqrt(h)) if linkage == "ward" else float(h)
            merges.append((int(ident[a]), int(ident[b]), height))
            ident[a] = next_id
            next_id += 1
        else:
            chain.append(b)
    return merges


def agglomerative(df: DataFrame, id_col: str, cols, k: int = 6, linkage: str = "ward",
                  micro_clusters: int | None = None, micro_col: str | None = None, seed: int = 42) -> DataFrame:
    """(id, cluster) for ``k`` clusters, merged from micro-clusters.

    Points are first summed up in micro-clusters: ``micro_col`` names them, or
    k-means makes ``micro_clusters`` of them (a point each, if there are no
    more points). One of the two is required, and the way is the same at every
    size. The micro-clusters' means and sizes, whose number that parameter
    sets, are merged in one task; points get their labels by a join.
    """
    if k is None or k < 1:
        raise ValueError("k must be a positive number of clusters")
    if (micro_clusters is None) == (micro_col is None):
        raise ValueError("give either micro_clusters or micro_col")
    cols = list(cols)
    pts = df.select(F.col(id_col).cast("long").alias("_id"), *(F.col(c).cast("double").alias(c) for c in cols),
                    *([F.col(micro_col).alias("_micro")] if micro_col else [])).dropna()
    if micro_col is None:
        n = pts.select(*cols).distinct().limit(micro_clusters).count()  # no more centres than distinct points
        if n == 0:
            return pts.select(F.col("_id").alias(id_col), F.lit(None).cast("int").alias("cluster"))
        best, kp = km.kmeans_runs(pts, "_id", cols, [n], n_init=1, seed=seed)
        pts = pts.join(km.assign(kp, best[n][0], out="_micro"), "_id")
    summary = pts.groupBy("_micro").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_micro", kind="stable")
        merges = merge_tree(pdf[cols].to_numpy(float), pdf["_n"].to_numpy(float), linkage)
        roots = cut_by_heights(len(pdf), merges, min(k, len(pdf)))
        return pd.DataFrame({"_micro": pdf["_micro"], "cluster": roots.astype("int32")})

    schema = f"_micro {pts.schema['_micro'].dataType.simpleString()}, cluster int"
    mapping = summary.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda key, pdf: merge(pdf), schema)
    labels = pts.select("_id", "_micro").join(mapping, "_micro").select("_id", "cluster")
    return km.relabel_by_first(labels, "_id", "cluster").withColumnRenamed("_id", id_col)


def cut_by_heights(n: int, merges, k: int) -> np.ndarray:
    """Union the leaves along the ``n - k`` lowest merges; a root id per leaf."""
    rep: dict[int, int] = {}

    def leaf(x: int) -> int:
        return x if x < n else rep[x]

    for i, (a, _b, _h) in enumerate(merges):
        rep[n + i] = leaf(a)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = sorted(range(len(merges)), key=lambda i: (merges[i][2], i))
    for i in order[: max(0, n - k)]:
        a, b, _h = merges[i]
        parent[find(leaf(a))] = find(leaf(b))
    return np.array([find(i) for i in range(n)])


def _points(df: DataFrame, id_col: str, cols) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _x) without nulls, and their distinct points (_c: smallest id, _n, _x)."""
    pts = df.select(F.col(id_col).cast("long").alias("_id"), F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols]).alias("_x")).where(
        F.col("_id").isNotNull() & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v))).checkpoint()
    return pts, pts.groupBy("_x").agg(F.min("_id").alias("_c"), F.count(F.lit(1)).alias("_n")).checkpoint()


def _labelled(pts: DataFrame, points: DataFrame, merges: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id, cluster) after all merges (d2, level, lo, hi) but the last k - 1 in order of height."""
    cut_off = merges.orderBy(F.desc("d2"), F.desc("level"), F.desc("lo"), F.desc("hi")).limit(k - 1)  # the parameter's size
    kept = merges.join(F.broadcast(cut_off.select("lo", "hi")), ["lo", "hi"], "left_anti") if k > 1 else merges
    groups = connected_components(_stars(kept), "lo", "hi")
    named = points.join(groups, F.col("_c") == F.col("_id"), "left").select("_x", F.coalesce("comp", "_c").alias("cluster"))
    labels = pts.join(named, "_x").select("_id", "cluster").checkpoint()
    return km.relabel_by_first(labels, "_id", "cluster").withColumnRenamed("_id", id_col)


def _stars(edges: DataFrame, few_edges: int = FEW_EDGES) -> DataFrame:
    """(lo, hi) with the same components: per part of about ``few_edges`` edges every node and the smallest node it is joined with there."""
    edges = edges.select("lo", "hi").checkpoint()

    def joined(batches):
        found = pd.concat([*batches, pd.DataFrame({"lo": np.zeros(0, np.int64), "hi": np.zeros(0, np.int64)})])
        _, nodes, least = _joined(found["lo"].to_numpy(), found["hi"].to_numpy())
        yield pd.DataFrame({"lo": least, "hi": nodes})

    return edges.repartition(max(1, -(-edges.count() // few_edges))).mapInPandas(joined, "lo long, hi long")


def _checked_k(k: int | None) -> int:
    if k is None or k < 1:
        raise ValueError("k must be a positive number of clusters")
    return k


def _plain_tree(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Minimum spanning tree of a few points (Prim): squared lengths and the two ends' places, ties by ids."""
    n = len(ids)
    best, first, last, source = np.full(n, np.inf), *(np.full(n, np.iinfo(np.int64).max) for _ in range(2)), np.zeros(n, np.int64)
    outside, now, rows = np.ones(n, bool), 0, []
    for _ in range(n - 1):
        outside[now] = False
        best[now] = np.inf
        d2 = ((x - x[now]) ** 2).sum(axis=1)
        # of equal distances the pair with the smallest ids: a total order of edges, so the tree is the same however it is found
        lo, hi = np.minimum(ids, ids[now]), np.maximum(ids, ids[now])
        better = outside & ((d2 < best) | ((d2 == best) & ((lo < first) | ((lo == first) & (hi < last)))))
        best[better], first[better], last[better], source[better] = d2[better], lo[better], hi[better], now
        near = np.flatnonzero((best == best.min()) & outside)
        now = int(near[np.lexsort((last[near], first[near]))[0]]) if len(near) > 1 else int(near[0])
        rows.append((best[now], source[now], now))
    d2, i, j = (np.array(c) for c in zip(*rows)) if rows else (np.zeros(0), *(np.zeros(0, np.int64) for _ in range(2)))
    return d2, i.astype(np.int64), j.astype(np.int64)


def _bottlenecks(weights: np.ndarray) -> np.ndarray:
    """For all pairs of nodes of a complete graph the least possible longest edge of a way between them."""
    n = len(weights)
    out, done, best, source = np.zeros((n, n)), np.zeros(n, bool), weights[0].copy(), np.zeros(n, np.int64)
    done[0] = True
    for _ in range(n - 1):
        now = int(np.where(done, np.inf, best).argmin())
        way = np.where(done, np.maximum(out[source[now]], best[now]), 0.0)
        out[now], out[:, now] = way, way
        done[now] = True
        nearer = weights[now] < best
        best[nearer], source[nearer] = weights[now][nearer], now
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joining pairs in their order: which of them joined two groups; the nodes and the smallest node of the group of each."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, used = list(range(len(nodes))), np.zeros(len(a), bool)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at, (i, j) in enumerate(zip(codes[:len(a)].tolist(), codes[len(a):].tolist())):
        i, j = find(i), find(j)
        if i != j:
            used[at] = True
            parent[max(i, j)] = min(i, j)
    return used, nodes, nodes[[find(i) for i in range(len(nodes))]] if len(nodes) else nodes


def _candidate_edges(points: DataFrame, n: int, block_rows: int) -> DataFrame:
    """(d2, lo, hi): few edges that hold the minimum spanning tree.

    An edge of the tree between two points of a tile is in the tile's own tree, and one
    between two tiles is in the tree of both together. Two tiles need not meet if a way
    over other tiles has edges that are all shorter than the gap between their boxes.
    """
    placed, boxes = tiled(points.select("_c", "_x"), "_c", n, block_rows)
    edge = "d2 double, lo long, hi long"

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["_c"].to_numpy()
        d2, i, j = _plain_tree(ids, blocks.stack(pdf["_x"]))
        return pd.DataFrame({"d2": d2, "lo": np.minimum(ids[i], ids[j]), "hi": np.maximum(ids[i], ids[j]), "_tile": int(pdf["_tile"].iloc[0])})

    local = placed.groupBy("_tile").applyInPandas(own, f"{edge}, _tile int").checkpoint()
    if len(boxes) < 2:
        return local.select("d2", "lo", "hi")
    inner = {r["_tile"]: r["m"] for r in local.groupBy("_tile").agg(F.max("d2").alias("m")).collect()}  # a row a tile
    inner = np.array([inner.get(t, 0.0) for t in boxes.index])
    sides = range(min(len(boxes["lo"].iloc[0]), 4))
    ends = placed.groupBy("_tile").agg(F.array(*[by("_x", F.col("_x")[c]) for c in sides for by in (F.min_by, F.max_by)]).alias("e")).toPandas()  # a row a tile
    ends = np.array([[list(p) for p in e] for e in ends.set_index("_tile").loc[boxes.index, "e"]], dtype=np.float64)
    weights = np.stack([((e[:, None, None, :] - ends[None]) ** 2).sum(axis=3).min(axis=(0, 2)) for e in ends])
    ways = _bottlenecks(np.maximum(weights, np.maximum(inner[:, None], inner[None, :])))
    both = meeting(placed, boxes, gaps(boxes) <= ways * (1 + 1e-9))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, first = pdf["_c"].to_numpy(), pdf["_first"].to_numpy()
        d2, i, j = _plain_tree(ids, blocks.stack(pdf["_x"]))
        cross = first[i] != first[j]
        d2, i, j = d2[cross], ids[i[cross]], ids[j[cross]]
        return pd.DataFrame({"d2": d2, "lo": np.minimum(i, j), "hi": np.maximum(i, j)})

    return local.select("d2", "lo", "hi").unionByName(both.groupBy("_pair").applyInPandas(across, edge)).checkpoint()


def spanning_tree(points: DataFrame, block_rows: int = TREE_ROWS, few_edges: int = FEW_EDGES) -> DataFrame:
    """(d2, lo, hi): minimum spanning tree of distinct points (_c, _x) by squared distance, ties by ids.

    Tiles of points and pairs of near tiles give candidate edges. While there are more
    than ``few_edges`` of them, components take their shortest edges in rounds, which at
    least halves the components; the last ``few_edges`` are sorted in one task.
    """
    n = points.count()
    if n < 2:
        return points.sparkSession.createDataFrame([], "d2 double, lo long, hi long")
    edges = _candidate_edges(points, n, block_rows).select("d2", "lo", "hi", F.col("lo").alias("_a"), F.col("hi").alias("_b"))
    tree, scratch = None, shared_dir(points.sparkSession, "tree")
    while edges.count() > few_edges:
        out = edges.select(F.col("_a").alias("_k"), "d2", "lo", "hi", F.col("_b").alias("_to")).unionByName(
            edges.select(F.col("_b").alias("_k"), "d2", "lo", "hi", F.col("_a").alias("_to")))
        shortest = out.groupBy("_k").agg(F.min(F.struct("d2", "lo", "hi", "_to")).alias("e")).select("_k", "e.*").checkpoint()
        taken = shortest.select("d2", "lo", "hi").distinct().checkpoint()
        tree = taken if tree is None else tree.unionByName(taken)
        roots = _roots(shortest.select("_k", "_to"))
        for end in ("_a", "_b"):
            edges = edges.join(roots.select(F.col("_k").alias(end), F.col("_root").alias(f"{end}_")), end).drop(end).withColumnRenamed(f"{end}_", end)
        edges = stored(edges.where("_a <> _b").groupBy(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).agg(
            F.min(F.struct("d2", "lo", "hi")).alias("e")).select("e.*", "_a", "_b"), scratch)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d2", "lo", "hi"], kind="stable")
        return pdf.loc[_joined(pdf["_a"].to_numpy(), pdf["_b"].to_numpy())[0], ["d2", "lo", "hi"]]

    rest = edges.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda key, pdf: finish(pdf), "d2 double, lo long, hi long")
    tree = (rest if tree is None else tree.unionByName(rest)).checkpoint()
    remove_path(points.sparkSession, scratch)
    return tree


def _roots(chosen: DataFrame) -> DataFrame:
    """(_k, _root): where the components' choices lead, by pointer jumping.

    Each component chose one other; two that chose each other are the only cycle, and
    the smaller of them is the root.
    """
    back = chosen.select(F.col("_k").alias("_to"), F.col("_to").alias("_back"))
    to = chosen.join(back, "_to", "left").select("_k", F.when((F.col("_back") == F.col("_k")) & (F.col("_k") < F.col("_to")), F.col("_k")).otherwise(F.col("_to")).alias("_root"))
    scratch = shared_dir(chosen.sparkSession, "roots")
    while True:
        to = stored(to, scratch)
        further = to.select(F.col("_k").alias("_root"), F.col("_root").alias("_next"))
        onward = to.join(further, "_root").select("_k", F.col("_next").alias("_root"), (F.col("_next") != F.col("_root")).alias("_moved")).checkpoint()
        to = onward.select("_k", "_root")
        if onward.where("_moved").isEmpty():
            remove_path(chosen.sparkSession, scratch)
            return to


def single_rows(df: DataFrame, id_col: str, cols, k: int = 6, block_rows: int = TREE_ROWS) -> DataFrame:
    """(id, cluster) for ``k`` single-linkage clusters of the rows themselves (of equal edges those with larger ids are cut first)."""
    _checked_k(k)
    pts, points = _points(df, id_col, list(cols))
    tree = spanning_tree(points, block_rows).withColumn("level", F.lit(0))
    return _labelled(pts, points, tree.checkpoint(), k, id_col)


CHUNK_POINTS = 128  # points of a cluster that are compared at once
SLACK = 1e-9  # room for rounding in bounds


def _near_pairs(members: DataFrame, linkage: str, block_rows: int) -> DataFrame:
    """(lo, hi, d2): pairs of clusters with their exact distance, among them each cluster's nearest ones.

    ``members`` are points (_c, _n, _x, _k: their cluster). Both linkages lie between the
    distance of the means and an upper bound: its sum with both radii (complete), or the
    root of its square plus both mean squared deviations (average). A pair is measured if
    the means are no farther than the least upper bound of one of the two.
    """
    d = len(members.select("_x").first()["_x"])
    x = [F.col("_x")[i] for i in range(d)]
    # a mean of equal numbers is that number
    mean = F.array(*[F.when(F.min(v) == F.max(v), F.min(v)).otherwise(F.sum(v * F.col("_n")) / F.sum("_n")) for v in x])
    means = members.groupBy("_k").agg(F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_w"), mean.alias("_mean")).checkpoint()
    off = F.aggregate(F.zip_with("_x", "_mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    spread = F.sqrt(F.max(off)) if linkage == "complete" else F.sum(off * F.col("_n")) / F.sum("_n")
    spreads = members.join(means, "_k").groupBy("_k").agg(spread.alias("_s"))
    clusters = means.join(spreads, "_k").select("_k", F.col("_mean").alias("_x"), "_s").checkpoint()
    placed, boxes = tiled(clusters, "_k", clusters.count(), block_rows)

    def bounds(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        away = blocks.euclidean(blocks.stack(a["_x"]), blocks.stack(b["_x"]))
        s = a["_s"].to_numpy()[:, None] + b["_s"].to_numpy()[None, :]
        upper = away + s if linkage == "complete" else np.sqrt(away * away + s)
        same = a["_k"].to_numpy()[:, None] == b["_k"].to_numpy()[None, :]
        away[same], upper[same] = np.inf, np.inf
        return away, upper * (1 + SLACK) + SLACK * SLACK

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(_u=bounds(pdf, pdf)[1].min(axis=1))

    def chosen(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        away, upper = bounds(a, b)
        least = np.minimum(a["_u"].to_numpy(), upper.min(axis=1))
        i, j = np.nonzero((away <= least[:, None]) & np.isfinite(away))
        return pd.DataFrame({"_k": a["_k"].to_numpy()[i], "_to": b["_k"].to_numpy()[j], "away": away[i, j], "upper": upper[i, j]})

    bounded = placed.groupBy("_tile").applyInPandas(first, "_k long, _x array<double>, _s double, _tile int, _u double").checkpoint()
    found = "_k long, _to long, away double, upper double"
    near = bounded.groupBy("_tile").applyInPandas(lambda pdf: chosen(pdf, pdf), found)
    if len(boxes) > 1:
        reach = bounded.groupBy("_tile").agg(F.max("_u").alias("u")).toPandas().set_index("_tile").loc[boxes.index, "u"].to_numpy()  # a row a tile
        both = meeting(bounded, boxes, np.sqrt(gaps(boxes)) * (1 - SLACK) <= np.maximum(reach[:, None], reach[None, :]))

        def across(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf["_first"]], pdf[~pdf["_first"]]
            return pd.concat([chosen(a, b), chosen(b, a)])

        near = near.unionByName(both.groupBy("_pair").applyInPandas(across, found))
    near = near.checkpoint()
    least = near.groupBy("_k").agg(F.min("upper").alias("_u"))
    wanted = near.join(least, "_k").where("away <= _u").groupBy(F.least("_k", "_to").alias("lo"), F.greatest("_k", "_to").alias("hi")).agg(F.min("away").alias("away"))
    sizes = lambda end, name: means.select(F.col("_k").alias(end), F.col("_m").alias(name))
    wanted = wanted.join(sizes("lo", "_a"), "lo").join(sizes("hi", "_b"), "hi").checkpoint()
    points = wanted.where("_a = 1 AND _b = 1").select("lo", "hi", F.col("away").alias("d2"))  # between single points: the distance itself
    return points.unionByName(_measured(wanted.where("_a > 1 OR _b > 1").select("lo", "hi"), members, means, linkage)).checkpoint()


def _measured(wanted: DataFrame, members: DataFrame, means: DataFrame, linkage: str) -> DataFrame:
    """(lo, hi, d2): the linkage's distance of pairs of clusters, over chunks of their points."""
    chunk = F.pmod(F.xxhash64("_c"), F.ceil(F.col("_m") / CHUNK_POINTS)).alias("_chunk")
    listed = members.join(means.select("_k", "_m", "_w"), "_k").groupBy("_k", "_w", chunk).agg(F.sort_array(F.collect_list(F.struct("_c", "_n", "_x"))).alias("_p"))
    listed = listed.select("_k", "_w", F.transform("_p", lambda p: p["_n"].cast("double")).alias("_n"), F.flatten(F.transform("_p", lambda p: p["_x"])).alias("_x")).checkpoint()
    side = lambda end: listed.select(F.col("_k").alias(end), *[F.col(c).alias(f"{end}{c}") for c in ("_w", "_n", "_x")])

    def parts(batches):
        for pdf in batches:
            v = np.empty(len(pdf))
            for at, (na, xa, nb, xb) in enumerate(zip(pdf["lo_n"], pdf["lo_x"], pdf["hi_n"], pdf["hi_x"])):
                d = blocks.euclidean(xa.reshape(len(na), -1), xb.reshape(len(nb), -1))
                v[at] = d.max() if linkage == "complete" else na @ d @ nb
            yield pdf[["lo", "hi", "lo_w", "hi_w"]].assign(v=v)

    met = wanted.join(side("lo"), "lo").join(side("hi"), "hi").mapInPandas(parts, "lo long, hi long, lo_w long, hi_w long, v double")
    value = F.max("v") if linkage == "complete" else F.sum("v") / F.first(F.col("lo_w") * F.col("hi_w"))
    return met.groupBy("lo", "hi").agg(value.alias("d2"))


def pair_rows(df: DataFrame, id_col: str, cols, k: int = 6, linkage: str = "average", block_rows: int = blocks.DEFAULT_BLOCK_ROWS,
              one_task: int = ONE_TASK) -> DataFrame:
    """(id, cluster) for ``k`` average- or complete-linkage clusters of the rows themselves.

    The last ``one_task`` clusters are merged in one task from their pairs, with the same result.
    """
    _checked_k(k)
    if linkage not in ("average", "complete"):
        raise ValueError(f"linkage must be average or complete: {linkage!r}")
    pts, points = _points(df, id_col, list(cols))
    size = points.select("_c", F.col("_n").cast("long").alias("_n")).checkpoint()
    together = F.sum if linkage == "average" else F.max
    members, merges, level = points.select("_c", "_n", "_x", F.col("_c").alias("_k")), None, 0
    scratch = shared_dir(df.sparkSession, "linkage")
    while size.count() > max(one_task, 1):
        away = _near_pairs(members, linkage, block_rows)
        ends = away.select(F.col("lo").alias("_c"), F.struct("d2", "lo", "hi").alias("e")).unionByName(away.select(F.col("hi").alias("_c"), F.struct("d2", "lo", "hi").alias("e")))
        near = ends.groupBy("_c").agg(F.min("e").alias("e"))
        done = near.groupBy("e").count().where("count = 2").select("e.*").withColumn("level", F.lit(level)).checkpoint()
        merges = done if merges is None else merges.unionByName(done)
        to = done.select(F.col("hi").alias("_c"), F.col("lo").alias("_to"))
        size = stored(size.join(to, "_c", "left").groupBy(F.coalesce("_to", "_c").alias("_c")).agg(F.sum("_n").alias("_n")), scratch)
        members = stored(members.join(to.withColumnRenamed("_c", "_k"), "_k", "left").select("_c", "_n", "_x", F.coalesce("_to", "_k").alias("_k")), scratch)
        level += 1

    # points in the order of their clusters, so that a block holds few clusters
    placed = dense_index(members, "_k", out="_at", tiebreak=("_c",)).checkpoint()
    cells, nb = blocks.with_cells(placed, "_c", placed.count(), block_rows, F.floor(F.col("_at") / block_rows))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = (f if isinstance(f, bool) else f.sort_values("_at") for f in blocks.split_cell(pdf, nb))
        if not len(left) or not len(right):
            return pd.DataFrame({"lo": np.zeros(0, np.int64), "hi": np.zeros(0, np.int64), "v": np.zeros(0)})
        d = blocks.euclidean(blocks.stack(left["_x"]), blocks.stack(right["_x"]))
        if linkage == "average":  # the sum over all rows of both points
            d = d * (left["_n"].to_numpy(float)[:, None] * right["_n"].to_numpy(float)[None, :])
        (ka, at_a), (kb, at_b) = (np.unique(f["_k"].to_numpy(), return_index=True) for f in (left, right))
        of = np.add if linkage == "average" else np.maximum
        v = of.reduceat(of.reduceat(d, at_a, axis=0), at_b, axis=1)
        a, b = np.broadcast_arrays(ka[:, None], kb[None, :])
        keep = (a < b) if same else a != b
        return pd.DataFrame({"lo": np.minimum(a, b)[keep], "hi": np.maximum(a, b)[keep], "v": v[keep]})

    def heights(table: DataFrame) -> DataFrame:
        if linkage == "complete":
            return table.withColumn("d2", F.col("v"))
        sizes = size.select(F.col("_c").alias("lo"), F.col("_n").alias("_a")), size.select(F.col("_c").alias("hi"), F.col("_n").alias("_b"))
        return table.join(sizes[0], "lo").join(sizes[1], "hi").withColumn("d2", F.col("v") / (F.col("_a") * F.col("_b"))).drop("_a", "_b")

    pairs = cells.groupBy("_cell").applyInPandas(cell, "lo long, hi long, v double").groupBy("lo", "hi").agg(together("v").alias("v")).checkpoint()

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, codes = np.unique(np.concatenate([pdf["lo"].to_numpy(), pdf["hi"].to_numpy()]), return_inverse=True)
        m, rows = len(ids), []
        lo, hi = codes[:len(pdf)], codes[len(pdf):]
        dist = np.full((m, m), np.inf)
        dist[lo, hi] = dist[hi, lo] = pdf["d2"].to_numpy()
        n = np.zeros(m)
        n[lo], n[hi] = pdf["_a"].to_numpy(), pdf["_b"].to_numpy()
        names = ids.tolist()
        for i, (a, b, h) in enumerate(merge_tree(np.zeros((m, 1)), n, linkage, dist)):
            first, last = sorted((names[a], names[b]))
            names.append(first)
            rows.append((h, first, last, level + i))
        return pd.DataFrame(rows, columns=["d2", "lo", "hi", "level"])

    sized = heights(pairs).join(size.select(F.col("_c").alias("lo"), F.col("_n").alias("_a")), "lo").join(size.select(F.col("_c").alias("hi"), F.col("_n").alias("_b")), "hi")
    rest = sized.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda key, pdf: finish(pdf), "d2 double, lo long, hi long, level int")
    merges = (rest if merges is None else merges.select("d2", "lo", "hi", "level").unionByName(rest)).checkpoint()
    remove_path(df.sparkSession, scratch)
    return _labelled(pts, points, merges, k, id_col)


def linkage_rows(df: DataFrame, id_col: str, cols, k: int = 6, linkage: str = "ward", **options) -> DataFrame:
    """(id, cluster) for ``k`` clusters of the rows themselves under any of the four linkages."""
    if linkage == "ward":
        return ward_rows(df, id_col, cols, k, **options)
    if linkage == "single":
        return single_rows(df, id_col, cols, k, **options)
    if linkage in LINKAGES:
        return pair_rows(df, id_col, cols, k, linkage, **options)
    raise ValueError(f"linkage must be one of {LINKAGES}")


def _nearest(now: DataFrame, m: int, block_rows: int) -> DataFrame:
    """(_c, near): the pair (squared height, smaller id, larger id) of every cluster with its nearest one."""
    cells, nb = blocks.with_cells(now, "_c", m, block_rows)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, n, k = blocks.stack(a["_x"]), blocks.stack(b["_x"]), a["_n"].to_numpy(float), b["_n"].to_numpy(float)
        ia, ib, rows = a["_c"].to_numpy(), b["_c"].to_numpy(), []
        for s in range(0, len(a), 128):
            e = slice(s, s + 128)
            d2 = ((x[e, None, :] - y[None, :, :]) ** 2).sum(axis=2) * (2.0 * n[e, None] * k[None, :] / (n[e, None] + k[None, :]))
            d2[ia[e, None] == ib[None, :]] = np.inf
            low = d2.min(axis=1)
            # of equal distances the pair with the smallest ids, so that some pair is always reciprocal
            other = np.where(d2 == low[:, None], ib[None, :], np.iinfo(np.int64).max).min(axis=1)
            rows.append(pd.DataFrame({"_c": ia[e], "d2": low, "lo": np.minimum(ia[e], other), "hi": np.maximum(ia[e], other)}))
        out = pd.concat(rows)
        return out[np.isfinite(out["d2"])]

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = blocks.split_cell(pdf, nb)
        if same:
            return best(left, left)
        none = pd.DataFrame({"_c": np.zeros(0, np.int64), "d2": np.zeros(0), "lo": np.zeros(0, np.int64), "hi": np.zeros(0, np.int64)})
        return pd.concat([best(left, right), best(right, left)]) if len(left) and len(right) else none

    found = cells.groupBy("_cell").applyInPandas(cell, "_c long, d2 double, lo long, hi long")
    return found.groupBy("_c").agg(F.min(F.struct("d2", "lo", "hi")).alias("near"))


def ward_rows(df: DataFrame, id_col: str, cols, k: int = 6, block_rows: int = blocks.DEFAULT_BLOCK_ROWS, one_task: int = ONE_TASK) -> DataFrame:
    """(id, cluster) for ``k`` Ward clusters of the rows themselves.

    Equal rows are one point with their count (they merge at height 0). Each
    round finds every cluster's nearest one in blocks and merges the reciprocal
    pairs; Ward's linkage is reducible, so these are merges of the greedy tree.
    The last ``one_task`` clusters are merged in one task by the same distances.
    The k - 1 highest merges are left out. Comparing all clusters is quadratic
    in the number of distinct points, with bounded tasks. Ids must be unique;
    rows with nulls are left out.
    """
    _checked_k(k)
    pts, points = _points(df, id_col, list(cols))
    now, merges, level = points.select("_c", "_n", "_x"), None, 0
    scratch = shared_dir(df.sparkSession, "linkage")
    while (m := now.count()) > max(one_task, 1):
        near = _nearest(now, m, block_rows)
        pairs = near.groupBy("near").count().where("count = 2").select("near.*").withColumn("level", F.lit(level)).checkpoint()
        moved = now.join(pairs.select(F.col("hi").alias("_c"), "lo"), "_c", "left").withColumn("_to", F.coalesce("lo", "_c"))
        # a merged cluster has two rows: the smaller id's stays first, so that sums don't depend on partitions
        both = moved.groupBy("_to").agg(F.sort_array(F.collect_list(F.struct("_c", "_n", "_x"))).alias("_p"))
        first, last = F.col("_p")[0], F.element_at("_p", -1)
        n = first["_n"] + last["_n"]
        mean = F.zip_with(first["_x"], last["_x"], lambda a, b: (first["_n"] * a + last["_n"] * b) / n)
        merged = F.size("_p") == 2
        now = stored(both.select(F.col("_to").alias("_c"), F.when(merged, n).otherwise(first["_n"]).alias("_n"),
                                 F.when(merged, mean).otherwise(first["_x"]).alias("_x")), scratch)
        merges = pairs if merges is None else merges.unionByName(pairs)
        level += 1

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_c", kind="stable")
        ids, rows = list(pdf["_c"]), []
        for i, (a, b, h) in enumerate(merge_tree(blocks.stack(pdf["_x"]), pdf["_n"].to_numpy(float), "ward")):
            lo, hi = sorted((ids[a], ids[b]))
            ids.append(lo)
            rows.append((h * h, lo, hi, level + i))
        return pd.DataFrame(rows, columns=["d2", "lo", "hi", "level"])

    rest = now.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda key, pdf: finish(pdf), "d2 double, lo long, hi long, level int")
    merges = (rest if merges is None else merges.unionByName(rest)).checkpoint()
    remove_path(df.sparkSession, scratch)
    return _labelled(pts, points, merges, k, id_col)
