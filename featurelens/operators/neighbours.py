"""Exact nearest neighbours with pruning by pivots.

Rows belong to their nearest of a few pivots (their cell) and a cell is cut
into rings by distance to its pivot: zones of about ``block_rows`` rows, by
which visits are pruned. What meets in a task is larger: zones that follow each
other are packed into bundles, and a zone beyond a bundle's size is cut by a
hash of the id, so no group grows with a dense region. There are about
``BUNDLES`` of them until they reach ``blocks.HOST_ROWS`` rows, so a row is
copied ``BUNDLES`` times at most up to 786,432 rows, whatever can be pruned.

1. Every row is compared with its own bundle, which bounds its k-th distance.
   Cells of more than k rows bound it too: distance to the pivot plus radius.
2. A row visits a bundle only if the triangle inequality leaves room for a row
   nearer than its bound in one of its zones: with pivot distance p and ring
   [lo, hi] the ring is at least max(p - hi, lo - p) away, and at least half of
   p less the distance to the row's own pivot. Visitors of a bundle come in
   groups of about ``GUEST_ROWS``, counted beforehand.

In a group costs come from matrix products, a few thousand numbers at a time;
only those within the bound are ranked. Where nothing can be pruned (uniform
points of many dimensions), time is that of all pairs. What the driver holds
and the tasks get are the pivots and the rings, at most ``max_pivots`` x
``MAX_RINGS``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.functions.columns import rnd, to_double_array
from featurelens.operators import blocks
from featurelens.session import ensure_code

METRICS = ("cosine", "euclidean", "manhattan")
MAX_RINGS = 16
TIE_DECIMALS = 12
#: Numbers a task lays out at once.
CHUNK_VALUES = 4_000_000
_EMIT_ROWS = 10_000
#: Bundles wanted of a table, of LEAST_ROWS rows or more; visitors in a group.
BUNDLES = 24
GUEST_ROWS = 65_536
#: Rows whose k-th cost is a first limit for the others of a bundle.
_FIRST_ROWS = 2048


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chunk = max(1, CHUNK_VALUES // max(1, b.size))
    out = np.empty((a.shape[0], b.shape[0]))
    for s in range(0, len(a), chunk):
        out[s:s + chunk] = np.abs(a[s:s + chunk, None, :] - b[None, :, :]).sum(axis=2)
    return out


def _distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances that obey the triangle inequality; for cosine those of the unit vectors."""
    if metric == "manhattan":
        return _manhattan(a, b)
    if metric == "euclidean":
        return blocks.euclidean(a, b, max(1, CHUNK_VALUES // max(1, b.size)))
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _cost(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """What neighbours are ranked by, least first: the negative cosine, or the distance."""
    raw = -(a @ b.T) if metric == "cosine" else _distance(a, b, metric)
    return blocks.rounded(raw, TIE_DECIMALS)


def _reach(cost: np.ndarray, metric: str) -> np.ndarray:
    """The distance that belongs to a cost."""
    return np.sqrt(np.maximum(0.0, 2.0 + 2.0 * cost)) if metric == "cosine" else cost


def _slack(metric: str, at: np.ndarray) -> np.ndarray:
    """Room for rounding: ties in the ranking, and sums in floating point."""
    return np.full(len(at), 1e-5) if metric == "cosine" else 1e-9 * (1.0 + np.where(np.isfinite(at), at, 0.0))


def _limits(bound: np.ndarray, metric: str) -> np.ndarray:
    """What ``_rough`` may be at most for rows within ``bound``, without the error of ``_rough``."""
    room = bound + _slack(metric, bound)
    return room if metric == "manhattan" else room ** 2 if metric == "euclidean" else (room ** 2 - 2.0) / 2


def _rough(b: np.ndarray, metric: str):
    """Function from rows to a matrix that orders the rows ``b`` as their costs do, and how far it may be off (not finite: of no use)."""
    if metric == "euclidean":
        return blocks.squared_to(b)
    if metric == "cosine":
        flipped = -b.T
        return lambda a: (a @ flipped, 2e-12)
    return lambda a: (_manhattan(a, b), 2e-12)


def _firsts(ids: np.ndarray, cost: np.ndarray, others: np.ndarray, k: int):
    """(row, column) of the ``k`` cheapest of every row, ties by column; never itself."""
    cost = np.where(ids[:, None] == others[None, :], np.inf, cost)
    kth = np.partition(cost, min(k, cost.shape[1]) - 1, axis=1)[:, min(k, cost.shape[1]) - 1][:, None]
    less = cost < kth
    ties = (cost == kth) & np.isfinite(cost)
    return np.nonzero(less | ties & (np.cumsum(ties, axis=1) <= k - less.sum(axis=1)[:, None]))


def _closest(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int, metric: str, bound: np.ndarray):
    """(row, neighbour, cost) of the ``k`` cheapest others within ``bound`` of every row, by row, cost, then id; never itself."""
    order = np.argsort(others, kind="stable")
    others, b = others[order], b[order]
    rough, limits = _rough(b, metric), _limits(bound, metric)
    step, many, out = max(1, CHUNK_VALUES // len(b)), 64 + 32 * k, []
    for s in range(0, len(a), step):
        own, rows = ids[s:s + step], a[s:s + step]
        value, error = rough(rows)
        if np.isfinite(error):
            limit = limits[s:s + step] + error
            open_ = np.flatnonzero(~np.isfinite(limit))
            if len(open_) and len(b) > 2 * _FIRST_ROWS and k <= _FIRST_ROWS:
                head = np.where(own[open_, None] == others[None, :_FIRST_ROWS], np.inf, value[open_, :_FIRST_ROWS])
                least = np.partition(head, k - 1, axis=1)[:, k - 1] + error
                if metric == "euclidean":
                    least = _limits(np.sqrt(np.maximum(least, 0.0)), metric)
                limit[open_] = least + error
            near = value <= limit[:, None]
            crowded = np.flatnonzero(np.count_nonzero(near, axis=1) > many)
            near[crowded] = False
            row, col = np.nonzero(near)
        else:
            crowded = np.arange(len(rows))
            row = col = np.zeros(0, np.int64)
        for c in range(0, len(crowded), 64):
            some = crowded[c:c + 64]
            r, o = _firsts(own[some], _cost(rows[some], b, metric), others, k)
            row, col = np.concatenate([row, some[r]]), np.concatenate([col, o])
        other = own[row] != others[col]
        row, col = row[other], col[other]
        cost = blocks.rounded(blocks.between(rows, b, row, col) if metric == "euclidean" else value[row, col], TIE_DECIMALS)
        by = np.lexsort((col, cost, row))
        row, col, cost = row[by], col[by], cost[by]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((row[best] + s, others[col[best]], cost[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pivots(data: DataFrame, metric: str, wanted: int) -> np.ndarray:
    """Distinct vectors of the rows whose ids hash lowest."""
    rows = data.orderBy(F.xxhash64("_id"), "_id").limit(wanted).select("_v").collect()  # a parameter's number of rows
    found = np.unique(np.array([r["_v"] for r in rows], dtype=np.float64), axis=0)
    # each followed by the nearest one left, so that neighbouring cells share bundles
    order, left = [], np.arange(len(found))
    while len(left):
        at = _distance(found[order[-1:]], found[left], metric)[0].argmin() if order else 0
        order.append(left[at])
        left = np.delete(left, at)
    return found[order]


def _bundle_rows(n: int, block_rows: int) -> int:
    return min(blocks.HOST_ROWS, max(min(block_rows, blocks.LEAST_ROWS), math.ceil(n / BUNDLES)))


def _bundles(zones: pd.DataFrame, most: int) -> None:
    """Add ``_bundle`` (zones that follow each other, of ``most`` rows together at most) and ``pieces`` (of a zone beyond that)."""
    bundle, rows, names = -1, 0, []
    for n in zones["n"]:
        if bundle < 0 or rows + n > most:
            bundle, rows = bundle + 1, 0
        rows += n
        names.append(bundle)
    zones["_bundle"] = np.array(names, dtype=np.int32)
    zones["pieces"] = np.ceil(zones.groupby("_bundle")["n"].transform("sum") / most).astype(np.int32)


def _with_zones(data: DataFrame, pivots: np.ndarray, metric: str, block_rows: int, bundle_rows: int) -> tuple[DataFrame, pd.DataFrame]:
    """Rows with ``_zone`` (a ring of a cell), ``_bundle`` and ``_piece``, and the table of zones."""
    spark = data.sparkSession

    def nearest_pivot(batches):
        for pdf in batches:
            if len(pdf):
                away = _distance(blocks.stack(pdf["_v"]), pivots, metric)
                cell = away.argmin(axis=1)
                yield pdf.assign(_cell=cell.astype(np.int32), _away=away[np.arange(len(pdf)), cell])

    placed = data.mapInPandas(nearest_pivot, f"{columns_of(data)}, _cell int, _away double").checkpoint()
    cells = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_away").alias("lo"), F.max("_away").alias("hi"))
    rings = cells.select("_cell", "lo", "hi", F.least(F.ceil(F.col("n") / block_rows), F.lit(MAX_RINGS)).cast("int").alias("_rings")).checkpoint()
    place = F.floor(F.try_divide(F.col("_away") - F.col("lo"), F.col("hi") - F.col("lo")) * F.col("_rings")).cast("int")
    ringed = placed.join(F.broadcast(rings), "_cell").withColumn("_ring", F.coalesce(F.least(place, F.col("_rings") - 1), F.lit(0)))  # a row a pivot
    zones = ringed.groupBy("_cell", "_ring").agg(F.count(F.lit(1)).alias("n"), F.min("_away").alias("lo"), F.max("_away").alias("hi")) \
        .toPandas().sort_values(["_cell", "_ring"], ignore_index=True)
    zones["_zone"] = np.arange(len(zones), dtype=np.int32)
    _bundles(zones, bundle_rows)
    named = spark.createDataFrame(zones[["_cell", "_ring", "_zone", "_bundle", "pieces"]], "_cell int, _ring int, _zone int, _bundle int, _pieces int")
    piece = F.pmod(F.xxhash64("_id"), F.col("_pieces")).cast("int")
    homed = ringed.join(F.broadcast(named), ["_cell", "_ring"])  # at most pivots x rings rows
    return homed.select(*data.columns, "_zone", "_bundle", piece.alias("_piece")), zones


def columns_of(df: DataFrame, *columns: str) -> str:
    """Names and types as a schema string."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (df.select(*columns) if columns else df).schema)


def _own(k: int, metric: str):
    """Group function: a bundle's rows with their best neighbours there and the bound these give."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors, ids = blocks.stack(pdf["_v"]), pdf["_id"].to_numpy()
        row, nbr, cost = _closest(ids, vectors, ids, vectors, k, metric, np.full(len(ids), np.inf))
        ends = np.cumsum(np.bincount(row, minlength=len(ids)))[:-1]
        costs = np.split(cost, ends)
        bound = [_reach(c[-1], metric) if len(c) == k else np.inf for c in costs]
        return pdf.assign(_nbrs=np.split(nbr, ends), _costs=costs, _bound=bound)

    return run


def _routes(pivots: np.ndarray, zones: pd.DataFrame, k: float, metric: str):
    """Function from a batch of rows to pieces of (row number, bundle) that must be visited; a row's own bundle is one of them."""
    cell, lo, hi = zones["_cell"].to_numpy(), zones["lo"].to_numpy(), zones["hi"].to_numpy()
    many = zones["n"].to_numpy() > k
    starts = np.flatnonzero(np.diff(zones["_bundle"].to_numpy(), prepend=-1))
    step = max(1, CHUNK_VALUES // max(len(zones), pivots.size, 1))

    def run(pdf: pd.DataFrame):
        for s in range(0, len(pdf), step):
            piece = pdf.iloc[s:s + step]
            away = _distance(blocks.stack(piece["_v"]), pivots, metric)
            bound = piece["_bound"].to_numpy()
            if many.any():
                bound = np.minimum(bound, (away[:, cell[many]] + hi[many]).min(axis=1))
            to = away[:, cell]
            least = np.maximum(np.maximum(to - hi, lo - to), (to - away.min(axis=1)[:, None]) / 2)
            visit = least <= (bound + _slack(metric, bound) + _slack(metric, away.max(axis=1)))[:, None]
            visit[np.arange(len(piece)), piece["_zone"].to_numpy()] = True
            row, bundle = np.nonzero(np.logical_or.reduceat(visit, starts, axis=1))
            yield row + s, bundle

    return run


def _guests(k: int, metric: str):
    """Group function: the best neighbours of a bundle's visitors among its rows."""
    none = pd.DataFrame({"_id": np.zeros(0, np.int64), "nbr": np.zeros(0, np.int64), "cost": np.zeros(0)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        guest, home = pdf[pdf["_guest"]], pdf[~pdf["_guest"]]
        if not len(guest) or not len(home):
            return none
        ids, bound = guest["_id"].to_numpy(), guest["_bound"].to_numpy()
        row, nbr, cost = _closest(ids, blocks.stack(guest["_v"]), home["_id"].to_numpy(), blocks.stack(home["_v"]), k, metric, bound)
        useful = _reach(cost, metric) <= bound[row] + _slack(metric, bound[row])
        return pd.DataFrame({"_id": ids[row][useful], "nbr": nbr[useful], "cost": cost[useful]})

    return run


def _meet(guests: DataFrame, hosts: DataFrame, routes, zones: pd.DataFrame, figures: dict, keep, home: bool = False) -> DataFrame:
    """Groups (_bundle, _piece, _group) of a bundle's ``hosts`` and the visitors (``_guest``) it gets, counted first.

    With ``home`` guests visit their own bundle too.
    """
    per = zones.groupby("_bundle").agg(n=("n", "sum"), pieces=("pieces", "first"))

    def counted(batches):
        total = np.zeros(len(per), np.int64)
        for pdf in batches:
            for _, bundle in routes(pdf):
                total += np.bincount(bundle, minlength=len(per))
        yield pd.DataFrame({"_bundle": np.flatnonzero(total).astype(np.int32), "n": total[total > 0]})

    visits = guests.select("_v", "_zone", "_bound").mapInPandas(counted, "_bundle int, n long").groupBy("_bundle").agg(F.sum("n").alias("n"))
    visitors = np.zeros(len(per), np.int64)
    for r in visits.collect():  # a row a bundle
        visitors[r["_bundle"]] = r["n"]
    pieces = per["pieces"].to_numpy()
    groups = np.maximum(1, np.ceil(visitors / GUEST_ROWS)).astype(np.int64)
    figures["copies"] = figures.get("copies", 0) + int((visitors * pieces).sum() + (per["n"].to_numpy() * groups * (visitors > 0)).sum())
    sizes = pd.DataFrame({"_bundle": per.index.to_numpy(), "_pieces": pieces, "_groups": groups, "_any": visitors > 0})
    sizes = F.broadcast(hosts.sparkSession.createDataFrame(sizes, "_bundle int, _pieces int, _groups long, _any boolean"))  # a row a bundle
    carried = ["_id", "_v", *keep]

    def sent(batches):
        for pdf in batches:
            for row, bundle in routes(pdf):
                for s in range(0, len(row), _EMIT_ROWS):
                    at = pdf.iloc[row[s:s + _EMIT_ROWS]]
                    yield at[carried].assign(_hbundle=at["_bundle"], _hpiece=at["_piece"], _bundle=bundle[s:s + _EMIT_ROWS].astype(np.int32))

    upto = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    came = guests.mapInPandas(sent, f"{columns_of(guests, *carried)}, _hbundle int, _hpiece int, _bundle int")
    came = came.join(sizes, "_bundle").withColumn("_piece", upto("_pieces"))
    if not home:
        came = came.where((F.col("_bundle") != F.col("_hbundle")) | (F.col("_piece") != F.col("_hpiece")))
    came = came.withColumn("_group", F.pmod(F.xxhash64("_id", F.lit(17)), F.col("_groups")).cast("int"))
    there = hosts.join(sizes, "_bundle").where("_any").withColumn("_group", upto("_groups"))
    side = lambda rows, guest: rows.select(*carried, "_bundle", "_piece", "_group", F.lit(guest).alias("_guest"))
    return side(came, True).unionByName(side(there, False))


def _pruned(data: DataFrame, n: int, k: int, metric: str, block_rows: int, max_pivots: int, figures: dict) -> DataFrame:
    """(_id, nbr, cost): candidates that hold the ``k`` nearest of every row of ``data``."""
    pivots = _pivots(data, metric, min(max_pivots, math.ceil(n / block_rows)))
    homed, zones = _with_zones(data, pivots, metric, block_rows, _bundle_rows(n, block_rows))
    first = homed.groupBy("_bundle", "_piece").applyInPandas(_own(k, metric), f"{columns_of(homed)}, _nbrs array<long>, _costs array<double>, _bound double").checkpoint()
    own = first.select("_id", F.explode(F.arrays_zip(F.col("_nbrs").alias("nbr"), F.col("_costs").alias("cost"))).alias("o")).select("_id", "o.*")
    rows = first.drop("_nbrs", "_costs")
    both = _meet(rows, rows, _routes(pivots, zones, k, metric), zones, figures, ["_bound"])
    figures["pivots"] = len(pivots)
    found = both.groupBy("_bundle", "_piece", "_group").applyInPandas(_guests(k, metric), "_id long, nbr long, cost double")
    return own.unionByName(found)


class Meetings:
    """Groups in which all pairs of rows within ``radius`` of each other meet.

    ``data`` has distinct ``_id``, finite vectors ``_v`` and any other columns.
    ``rows`` are its rows with their place: those of a (_bundle, _piece) are near
    each other and bounded in number.
    """

    def __init__(self, data: DataFrame, n: int, radius: float, metric: str = "euclidean", block_rows: int = blocks.DEFAULT_BLOCK_ROWS, max_pivots: int = 1024):
        self.figures: dict = {}  # copies: how often rows were sent, so far
        pivots = _pivots(data, metric, min(max_pivots, math.ceil(n / block_rows)))
        homed, self.zones = _with_zones(data, pivots, metric, block_rows, _bundle_rows(n, block_rows))
        self.rows = homed.withColumn("_bound", F.lit(float(radius)))
        self.routes = _routes(pivots, self.zones, math.inf, metric)
        self.bundles = int(self.zones.groupby("_bundle")["pieces"].first().sum())

    def groups(self, guests: DataFrame, hosts: DataFrame, keep=(), home: bool = True) -> DataFrame:
        """(_id, _v, *keep, _bundle, _piece, _group, _guest): every guest with all hosts that may be within ``radius``.

        Both are forms of ``self.rows``, or some of its rows. Without ``home`` a guest doesn't meet those of its own piece.
        """
        return _meet(guests, hosts, self.routes, self.zones, self.figures, list(keep), home)


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int = 5, metric: str = "cosine", zero_norm: float = 0.0,
            block_rows: int = blocks.DEFAULT_BLOCK_ROWS, max_pivots: int = 1024, figures: dict | None = None) -> DataFrame:
    """Exact ``k`` nearest other rows of every row: (id, rank, nbr, similarity or distance).

    Ranked by the value itself (differences below 1e-12 are ties, which go to
    the smaller id); only what is returned is rounded, to 6 decimals. Ids are
    distinct whole numbers; rows with a null id, a null vector or an entry that
    is null or not finite have no neighbours and are none. For cosine a zero
    vector has similarity ``zero_norm`` to every row. An empty table gives an
    empty result. ``figures`` receives the number of row copies and of pivots.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1 or block_rows < 1 or max_pivots < 1:
        raise ValueError(f"k, block_rows and max_pivots must be positive: {k}, {block_rows}, {max_pivots}")
    ensure_code(df.sparkSession)
    figures = {} if figures is None else figures
    figures.update(copies=0, pivots=0)
    usable = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    data = df.select(F.col(id_col).cast("long").alias("_id"), to_double_array(vec_col).alias("_v")).where("_id IS NOT NULL").where(F.coalesce(usable, F.lit(False)))
    value = "similarity" if metric == "cosine" else "distance"
    plain = None
    if metric == "cosine":
        length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
        data = data.withColumn("_l", length).checkpoint()
        zeros = data.where("_l = 0")
        lowest = lambda d: [r["_id"] for r in d.orderBy("_id").select("_id").limit(k + 1).collect()]  # noqa: E731  k + 1 ids
        zero_ids, all_ids = lowest(zeros), lowest(data)
        data = data.where("_l > 0").select("_id", F.transform("_v", lambda x: x / F.col("_l")).alias("_v"))
        if zero_ids:
            each = lambda d, ids: d.select("_id", F.explode(F.array(*[F.lit(i) for i in ids])).alias("nbr")).where("_id <> nbr")
            plain = each(data, zero_ids).unionByName(each(zeros, all_ids)).select("_id", "nbr", F.lit(-float(zero_norm)).alias("cost"))
    else:
        data = data.checkpoint()
    n = data.count()
    if n:
        found = _pruned(data, n, k, metric, block_rows, max_pivots, figures)
    else:
        found = data.select("_id", F.col("_id").alias("nbr"), F.lit(0.0).alias("cost")).limit(0)
    if plain is not None:
        found = found.unionByName(plain)
    ranks = Window.partitionBy("_id").orderBy("cost", "nbr")
    top = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    shown = -F.col("cost") if metric == "cosine" else F.col("cost")
    return top.select(F.col("_id").alias(id_col), "rank", "nbr", rnd(shown, 6).alias(value))
