"""Density-based clustering (DBSCAN semantics: eps, min_samples counting the
point itself, noise -1) as Spark jobs.

* Grid join (J7): cells of side ``eps`` / sqrt(d), so that rows of a cell are
  within ``eps`` of each other. A cell of ``min_samples`` rows or more is all
  core and one node; it is linked with others by its outermost points, and by
  its rows only where these don't decide.
* Rows of sparse cells are joined with the rows of the cells around: their
  degrees, and their links with core rows (a dense cell counts as one).
* Components over these links: min-label propagation, checkpointed every
  round, capped and failing loudly.
* Above three dimensions, rings around pivots take the place of the grid
  (``dbscan_vectors``).
* Cluster numbers follow the smallest member id; a border point takes the
  smallest cluster number among its core neighbours.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions.columns import to_double_array
from featurelens.operators import blocks
from featurelens.operators.neighbours import CHUNK_VALUES, Meetings, columns_of
from featurelens.operators.positions import dense_index
from featurelens.session import ensure_code, remove_path, shared_dir

MAX_ROUNDS = 60
FIRST_GUESTS = 256       # core rows of a bundle that link it with others first
GRID_DIMENSIONS = 3      # beyond these a cell has too many neighbours (3^d)

def _within(a, b, eps: float):
    """Whether two points (arrays) are at most ``eps`` apart."""
    away = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return away * away <= F.lit(eps * eps)


def _dense_links(p: DataFrame, cells: DataFrame, offsets: list, eps: float) -> DataFrame:
    """(src, dst): dense cells, by their smallest ids, that hold rows within ``eps`` of each other.

    Most are linked by their outermost points. Only cells that are near, not linked so and
    not in one component anyway have their rows compared, those near the other's box.
    """
    half = [o for o in offsets if o > (0,) * len(o)]
    off = F.explode(F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in half]))
    side = lambda name: cells.select(*[F.col(c).alias(f"{name}{c}") for c in ("_cell", "_rep", "_lo", "_hi", "_ends")])
    first = side("a").withColumn("_off", off).withColumn("b_cell", F.zip_with("a_cell", "_off", lambda x, y: x + y)).drop("_off")
    linked = F.exists("a_ends", lambda x: F.exists("b_ends", lambda y: _within(x, y, eps)))
    pairs = first.join(side("b"), "b_cell").withColumn("_linked", linked).checkpoint()
    sure = pairs.where("_linked").select(F.col("a_rep").alias("src"), F.col("b_rep").alias("dst"))
    zero = F.lit(0.0)
    gap = F.zip_with(F.zip_with("a_lo", "b_hi", lambda x, y: x - y), F.zip_with("b_lo", "a_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, zero))
    room = F.lit(eps * eps * (1 + 1e-9))
    rest = pairs.where(~F.col("_linked") & (F.aggregate(gap, zero, lambda s, v: s + v * v) <= room))
    if rest.isEmpty():
        return sure
    groups = connected_components(sure.unionByName(cells.select(F.col("_rep").alias("src"), F.col("_rep").alias("dst"))))
    for name in ("a", "b"):
        rest = rest.join(groups.select(F.col("_id").alias(f"{name}_rep"), F.col("comp").alias(f"{name}_comp")), f"{name}_rep")
    rest = rest.where("a_comp <> b_comp").select("a_cell", "a_rep", "a_lo", "a_hi", "b_cell", "b_rep", "b_lo", "b_hi").checkpoint()

    def near(name: str, other: str) -> DataFrame:
        rows = p.select(F.col("_cell").alias(f"{name}_cell"), F.col("_x").alias(f"{name}_x")).join(rest, f"{name}_cell")
        out = F.zip_with(F.zip_with(f"{other}_lo", f"{name}_x", lambda x, y: x - y), F.zip_with(f"{name}_x", f"{other}_hi", lambda x, y: x - y),
                         lambda x, y: F.greatest(x, y, zero))
        return rows.where(F.aggregate(out, zero, lambda s, v: s + v * v) <= room).select("a_rep", "b_rep", f"{name}_x").distinct()

    met = near("a", "b").join(near("b", "a"), ["a_rep", "b_rep"]).where(_within("a_x", "b_x", eps))
    return sure.unionByName(met.select(F.col("a_rep").alias("src"), F.col("b_rep").alias("dst")).distinct())


def dbscan(df: DataFrame, id_col: str, cols, eps: float = 0.5, min_samples: int = 3,
           block_rows: int = 1024, dense_cells: bool | None = None) -> DataFrame:
    """M8 + J7: (id, cluster) with noise as -1.

    ``dense_cells=False`` compares all rows of cells of side ``eps`` instead.
    ``block_rows`` is for more than three columns."""
    ensure_code(df.sparkSession)
    if eps is None or eps <= 0 or min_samples is None or min_samples < 1:
        raise ValueError("eps must be > 0 and min_samples >= 1")
    cols = list(cols)
    d = len(cols)
    if d > GRID_DIMENSIONS:
        one = df.select(F.col(id_col), F.array(*[F.col(c).cast("double") for c in cols]).alias("_row"))
        return dbscan_vectors(one.where(F.forall("_row", lambda x: x.isNotNull())), id_col, "_row", eps, min_samples, block_rows)
    eps = float(eps)
    pts = df.select(F.col(id_col).cast("long").alias("_id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).dropna()
    usable = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    dense_mode = dense_cells is None or dense_cells
    side = eps / math.sqrt(d) if dense_mode else eps
    r = math.ceil(math.sqrt(d)) if dense_mode else 1
    cell = F.transform("_x", lambda x: F.floor(x / F.lit(side)).cast("long"))
    pts = pts.withColumn("_ok", F.coalesce(usable, F.lit(False))).withColumn("_cell", F.when(F.col("_ok"), cell)).checkpoint()
    p = pts.where("_ok").drop("_ok")
    x = [F.col("_x")[i] for i in range(d)]
    ways = [w for w in itertools.product((-1, 0, 1), repeat=d) if any(w)]
    ends = F.array(*[F.max_by("_x", sum((v * float(k) for v, k in zip(x, w)), F.lit(0.0))) for w in ways])
    cells = p.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_rep"), F.array(*[F.min(v) for v in x]).alias("_lo"),
                                   F.array(*[F.max(v) for v in x]).alias("_hi"), ends.alias("_ends"))
    cells = cells.withColumn("_dense", F.lit(dense_mode) & (F.col("_n") >= min_samples)).checkpoint()
    # neighbour cells that can hold a point within eps (boundary distance <= eps)
    offsets = [o for o in itertools.product(range(-r, r + 1), repeat=d)
               if side * side * sum(max(abs(v) - 1, 0) ** 2 for v in o) <= eps ** 2 * (1 + 1e-12)]
    homed = p.join(cells.select("_cell", "_rep", "_dense"), "_cell").checkpoint()

    # rows of sparse cells meet the rows of the cells around; dense cells count as one node there
    sparse = homed.where("NOT _dense").select(F.col("_id").alias("_s"), F.col("_x").alias("_sx"), "_cell")
    off = F.explode(F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in offsets]))
    sparse = sparse.withColumn("_off", off).select("_s", "_sx", F.zip_with("_cell", "_off", lambda a, b: a + b).alias("_cell"))
    node = F.when(F.col("_dense"), F.col("_rep")).otherwise(F.col("_id"))
    met = sparse.join(homed, "_cell").where(_within("_sx", "_x", eps)).groupBy("_s", node.alias("_node"), "_dense").agg(F.count(F.lit(1)).alias("cnt")).checkpoint()
    # an id of several rows is one point in several places
    twice = p.groupBy("_id").count().where("count > 1").select("_id")
    placed = homed.where("_dense").join(twice, "_id").select("_id", "_rep").distinct().checkpoint()
    core = met.groupBy("_s").agg(F.sum("cnt").alias("deg")).where(F.col("deg") >= min_samples).select(F.col("_s").alias("_id"))
    core = core.unionByName(placed.select("_id").join(met.select(F.col("_s").alias("_id")), "_id", "left_semi")).distinct().checkpoint()
    to_core = met.where("_dense").select("_s", "_node").unionByName(
        met.where("NOT _dense").join(core.withColumnRenamed("_id", "_node"), "_node", "left_semi").select("_s", "_node"))
    from_core = to_core.join(core.withColumnRenamed("_id", "_s"), "_s", "left_semi")
    border = to_core.join(core.withColumnRenamed("_id", "_s"), "_s", "left_anti")
    dense = cells.where("_dense")
    pair = lambda t, a, b: t.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    star = pair(dense, "_rep", "_rep").unionByName(pair(core, "_id", "_id")).unionByName(pair(from_core, "_s", "_node")).unionByName(pair(placed, "_id", "_rep"))
    comp = connected_components(star.unionByName(_dense_links(p, dense, offsets, eps)).distinct())
    firsts = comp.groupBy("comp").agg(F.min("_id").alias("_first"))
    numbered = dense_index(firsts, "_first", out="cluster").select("comp", F.col("cluster").cast("int"))
    labels = comp.join(numbered, "comp").select(F.col("_id").alias("_node"), "cluster").checkpoint()
    border = border.join(labels, "_node").groupBy(F.col("_s").alias("_id")).agg(F.min("cluster").alias("_border"))
    rows = homed.select("_id", node.alias("_node")).unionByName(pts.where("NOT _ok").select("_id", F.lit(None).cast("long").alias("_node")))
    return rows.join(labels, "_node", "left").join(border, "_id", "left").select(
        F.col("_id").alias(id_col), F.coalesce("cluster", "_border", F.lit(-1)).cast("int").alias("cluster"))


def _near(a: np.ndarray, b: np.ndarray, eps: float):
    """Pieces (first row, whether the rows of ``a`` from there on are within ``eps`` of those of ``b``); distances at the limit are by differences."""
    rough, room = blocks.squared_to(b), eps * eps
    step = max(1, CHUNK_VALUES // max(1, len(b)))
    for s in range(0, len(a), step):
        rows = a[s:s + step]
        d2, error = rough(rows)
        if not np.isfinite(error):
            yield s, blocks.euclidean(rows, b, max(1, CHUNK_VALUES // max(1, b.size))) ** 2 <= room
            continue
        near = d2 <= room * (1 + 1e-12) + error
        sure = d2 <= room * (1 - 1e-12) - error
        if np.count_nonzero(near) > np.count_nonzero(sure):
            row, col = np.nonzero(near & ~sure)
            near[row, col] = blocks.between(rows, b, row, col) ** 2 <= room
        yield s, near


def _degrees(a: np.ndarray, b: np.ndarray, weights: np.ndarray, eps: float) -> np.ndarray:
    """Weight of the rows of ``b`` within ``eps`` of every row of ``a``."""
    out = np.zeros(len(a), np.int64)
    for s, near in _near(a, b, eps):
        row, col = np.nonzero(near)
        out[s:s + len(near)] = _sums(row, weights[col], len(near))
    return out


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by row (sorted)."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.searchsorted(row, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def _components(x: np.ndarray, eps: float) -> np.ndarray:
    """For every row the first row of its component under links of at most ``eps``."""
    parent = np.arange(len(x))
    for s, near in _near(x, x, eps):
        row, col = np.nonzero(near)
        a, b = parent[row + s], parent[col]
        while len(other := np.flatnonzero(a != b)):
            a, b = a[other], b[other]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            a, b = parent[a], parent[b]
    return parent


def _local(eps: float):
    """Group function on core rows of a bundle: (_id, node), the node being the smallest id of the component here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        ids = pdf["_id"].to_numpy()
        return pd.DataFrame({"_id": ids, "_node": ids[_components(blocks.stack(pdf["_v"]), eps)]})

    return run


def _links(eps: float):
    """Group function on rows with their ``_node`` (null: not core): (src, dst), distinct, a guest's node (or, not core, its id) and another node of core rows within ``eps`` of it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        guest, host = pdf[pdf["_guest"]], pdf[~pdf["_guest"]]
        found = [np.zeros((0, 3), np.int64)]
        if len(guest) and len(host):
            names, of = np.unique(host["_node"].to_numpy().astype(np.int64), return_inverse=True)
            core = guest["_core"].to_numpy()
            src = np.where(core, guest["_node"].fillna(0).to_numpy().astype(np.int64), guest["_id"].to_numpy())
            for s, near in _near(blocks.stack(guest["_v"]), blocks.stack(host["_v"]), eps):
                row, col = np.nonzero(near)
                pairs = np.unique(row * len(names) + of[col])  # a row and a node once
                row, dst = pairs // len(names) + s, names[pairs % len(names)]
                other = ~core[row] | (src[row] != dst)
                found.append(np.stack([src[row], dst, core[row].astype(np.int64)], axis=1)[other])
        out = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"src": out[:, 0], "dst": out[:, 1], "core": out[:, 2] == 1})

    return run


def dbscan_vectors(df: DataFrame, id_col: str, vec_col: str, eps: float = 0.5, min_samples: int = 3,
                   block_rows: int = 1024, max_pivots: int = 1024, figures: dict | None = None) -> DataFrame:
    """M8 + J7 for vectors of any width: (id, cluster) with noise as -1.

    Neighbours meet in rings around pivots (``neighbours.Meetings``) instead
    of adjacent cells, whose number grows as 3^d. Equal vectors are one point
    with a weight, so any number of copies costs no pairs.

    Rows meet their own bundle first. Those with ``min_samples`` neighbours
    there are core and visit no others to be counted; components there are
    nodes. A few core rows of every bundle then link nodes of different
    bundles. After that only rows outside the largest component visit all
    bundles in reach: of two core rows of different components one is
    outside, so no link is missed.

    Ids are distinct whole numbers. Rows with a null id, a null vector or an
    entry that is null or not finite are left out; an empty table gives an
    empty result. A border row takes the smallest cluster number among its
    core neighbours. ``figures`` receives the number of row copies.
    """
    if eps is None or eps <= 0 or min_samples is None or min_samples < 1:
        raise ValueError("eps must be > 0 and min_samples >= 1")
    ensure_code(df.sparkSession)
    usable = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    pts = df.select(F.col(id_col).cast("long").alias("_key"), to_double_array(vec_col).alias("_v")).where("_key IS NOT NULL")
    # 0.0 + x makes both zeros one
    pts = pts.where(F.coalesce(usable, F.lit(False))).withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0))).checkpoint()
    places = pts.groupBy("_v").agg(F.min("_key").alias("_id"), F.count(F.lit(1)).alias("_w")).checkpoint()
    n = places.count()
    if not n:
        return pts.select(F.col("_key").alias(id_col), F.lit(-1).alias("cluster"))
    eps = float(eps)
    meetings = Meetings(places.select("_id", "_v", "_w"), n, eps, "euclidean", block_rows, max_pivots)
    piece, group = ["_bundle", "_piece"], ["_bundle", "_piece", "_group"]

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        x = blocks.stack(pdf["_v"])
        return pdf.assign(_n=_degrees(x, x, pdf["_w"].to_numpy(), eps))

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        guest, host = pdf[pdf["_guest"]], pdf[~pdf["_guest"]]
        if not len(guest) or not len(host):
            return pd.DataFrame({"_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        return pd.DataFrame({"_id": guest["_id"].to_numpy(), "n": _degrees(blocks.stack(guest["_v"]), blocks.stack(host["_v"]), host["_w"].to_numpy(), eps)})

    rows = meetings.rows
    rows = rows.groupBy(*piece).applyInPandas(counted, f"{columns_of(rows)}, _n long").checkpoint()
    if meetings.bundles > 1:
        poor = meetings.groups(rows.where(F.col("_n") < min_samples), rows, ["_w"], home=False)
        more = poor.groupBy(*group).applyInPandas(added, "_id long, n long").groupBy("_id").agg(F.sum("n").alias("_more"))
        rows = rows.join(more, "_id", "left").withColumn("_n", F.col("_n") + F.coalesce("_more", F.lit(0))).drop("_more")
    rows = rows.withColumn("_core", F.col("_n") >= min_samples).drop("_n", "_w").checkpoint()
    local = rows.where("_core").groupBy(*piece).applyInPandas(_local(eps), "_id long, _node long")
    rows = rows.join(local, "_id", "left").checkpoint()

    def linked(guests: DataFrame, hosts: DataFrame) -> DataFrame:
        return meetings.groups(guests, hosts, ["_core", "_node"]).groupBy(*group).applyInPandas(_links(eps), "src long, dst long, core boolean").checkpoint()

    def joined(rows: DataFrame, links: DataFrame) -> DataFrame:
        nodes = rows.where("_core").select(F.col("_node").alias("src"), F.col("_node").alias("dst"))
        comp = connected_components(nodes.unionByName(links.where("core").select("src", "dst")).distinct())
        return rows.join(comp.select(F.col("_id").alias("_node"), "comp"), "_node", "left").withColumn("_node", F.col("comp")).drop("comp").checkpoint()

    if meetings.bundles > 1:
        some = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(max(1, n // (meetings.bundles * FIRST_GUESTS)))) == 0
        rows = joined(rows, linked(rows.where("_core").where(some), rows.where("_core")))
        largest = rows.where("_core").groupBy("_node").count().orderBy(F.desc("count"), "_node").limit(1).collect()
        outside = rows.where(~F.col("_core") | (F.col("_node") != F.lit(largest[0]["_node"] if largest else None)))
        links = linked(outside, rows.where("_core"))
        final = joined(rows, links)
    else:
        links = linked(rows.where("NOT _core"), rows.where("_core"))
        final = rows
    if figures is not None:
        figures.update(meetings.figures)
    # a node that a border row was linked with has another name where components were joined since
    names = rows.where("_core").select("_id", F.col("_node").alias("dst")).join(final.select("_id", F.col("_node").alias("comp")), "_id").select("dst", "comp").distinct()
    firsts = final.where("_core").groupBy(F.col("_node").alias("comp")).agg(F.min("_id").alias("_first"))
    numbered = dense_index(firsts, "_first", out="cluster").select("comp", F.col("cluster").cast("int"))
    labels = final.where("_core").select("_id", F.col("_node").alias("comp")).join(numbered, "comp").select("_id", "cluster")
    border = links.where("NOT core").join(names, "dst").join(numbered, "comp").groupBy(F.col("src").alias("_id")).agg(F.min("cluster").alias("cluster"))
    known = places.select("_id", F.col("_v")).join(labels.unionByName(border), "_id").drop("_id")
    return pts.join(known, "_v", "left").select(F.col("_key").alias(id_col), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(``_id``, ``comp`` = smallest id in the component) for every node of ``edges``.

    Alternating large-star / small-star rounds (O(log^2 n) rounds). Each step
    is a ``min`` aggregate per node joined back to the edges - no neighbour
    list is ever collected, so a hub node with millions of edges is just a
    large partial aggregate. Each round's edges are written to the shared
    folder and read back (lineage cut); the loop stops when a round leaves
    the edge set unchanged (exact anti-join test).
    """
    spark = edges.sparkSession
    scratch = shared_dir(spark, "components")
    rounds = 0

    def persist(df: DataFrame) -> DataFrame:
        nonlocal rounds
        rounds += 1
        df.write.mode("overwrite").parquet(f"{scratch}/r{rounds}")
        return spark.read.parquet(f"{scratch}/r{rounds}")

    def drop_round(i: int) -> None:
        if i > 0:
            remove_path(spark, f"{scratch}/r{i}")

    def undirected(pairs: DataFrame) -> DataFrame:
        p = pairs.filter(F.col("u") != F.col("v"))
        return p.unionByName(p.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()

    def large_star(g: DataFrame) -> DataFrame:
        m = g.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return undirected(g.filter(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))

    def small_star(g: DataFrame) -> DataFrame:
        low = g.filter(F.col("v") <= F.col("u"))
        m = low.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = low.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = m.select("u", F.col("m").alias("v"))
        return undirected(moved.unionByName(own))

    given = persist(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")))   # evaluated once
    nodes = given.select(F.col("u").alias("_id")).unionByName(given.select(F.col("v").alias("_id"))).distinct()
    e = given.filter(F.col("u") != F.col("v"))
    e = persist(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    for _ in range(MAX_ROUNDS):
        prev = rounds
        nxt = persist(small_star(large_star(e)))
        diff = nxt.withColumn("_new", F.lit(1)).join(e.withColumn("_old", F.lit(1)), ["u", "v"], "full_outer")
        changed = diff.filter(F.col("_new").isNull() | F.col("_old").isNull()).limit(1).count()
        e = nxt
        drop_round(prev)                                  # the superseded round is no longer read
        if changed == 0:
            comp = e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("comp")).withColumnRenamed("u", "_id")
            return nodes.join(comp, "_id", "left").select("_id", F.coalesce("comp", "_id").alias("comp"))
    raise RuntimeError("connected components did not converge")
