"""Rows of few columns in boxes (tiles) of about ``block_rows`` rows.

A sample of the rows, whose size is set by the number of tiles, is halved along
its widest column until there are enough tiles; every row then goes to its
tile. The sample decides how even the tiles are, never a result: what is
pruned is pruned by the boxes of the rows themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.operators import blocks
from featurelens.session import ensure_code

MAX_TILES = 2048      # the driver compares tiles with each other
SAMPLE_ROWS = 24      # sampled rows a tile


def _halved(x: np.ndarray, leaves: int, count: list[int]):
    """Nested (column, value, lower half, upper half); a leaf is its number."""
    width = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
    if leaves < 2 or not width.max() > 0:
        count[0] += 1
        return count[0] - 1
    c = int(width.argmax())
    values = np.sort(x[:, c])
    at = values[min(len(x) * (leaves // 2) // leaves, len(x) - 1)]
    at = at if at < values[-1] else values[values < values[-1]][-1]
    low = x[:, c] <= at
    return c, float(at), _halved(x[low], leaves // 2, count), _halved(x[~low], leaves - leaves // 2, count)


def _placed(x: np.ndarray, tree) -> np.ndarray:
    out, todo = np.zeros(len(x), np.int32), [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, int):
            out[rows] = node
        elif len(rows):
            low = x[rows, node[0]] <= node[1]
            todo += [(node[2], rows[low]), (node[3], rows[~low])]
    return out


def tiled(df: DataFrame, key: str, n: int, block_rows: int) -> tuple[DataFrame, pd.DataFrame]:
    """``df`` with ``_tile``, checkpointed, and the tiles' table: n, lo, hi (corners of the box), by tile."""
    ensure_code(df.sparkSession)
    wanted = min(MAX_TILES, max(1, math.ceil(n / block_rows)))
    rows = df.orderBy(F.xxhash64(key), key).limit(wanted * SAMPLE_ROWS if wanted > 1 else 1).select("_x").collect()  # the tiles' number of rows
    x = np.array([r["_x"] for r in rows], dtype=np.float64)
    if not len(x):
        return df.withColumn("_tile", F.lit(0)).checkpoint(), pd.DataFrame({"n": [], "lo": [], "hi": []})
    tree = _halved(x, wanted, [0])

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(_tile=_placed(blocks.stack(pdf["_x"]), tree))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    placed = df.mapInPandas(place, f"{schema}, _tile int").checkpoint()
    corner = lambda of: F.array(*[of(F.col("_x")[i]) for i in range(x.shape[1])])
    boxes = placed.groupBy("_tile").agg(F.count(F.lit(1)).alias("n"), corner(F.min).alias("lo"), corner(F.max).alias("hi")).toPandas()  # a row a tile
    return placed, boxes.set_index("_tile").sort_index()


def gaps(boxes: pd.DataFrame) -> np.ndarray:
    """Squared distances between the boxes of tiles: no two of their rows are nearer."""
    lo, hi = blocks.stack(boxes["lo"]), blocks.stack(boxes["hi"])
    out = np.zeros((len(lo), len(lo)))
    for c in range(lo.shape[1]):
        out += np.maximum(0.0, np.maximum(lo[:, None, c] - hi[None, :, c], lo[None, :, c] - hi[:, None, c])) ** 2
    return out


def meeting(placed: DataFrame, boxes: pd.DataFrame, wanted: np.ndarray) -> DataFrame:
    """The rows of every pair of tiles in ``wanted`` (tile x tile, i < j), grouped by ``_pair``; ``_first``: the row is of tile i."""
    names = boxes.index.to_numpy()
    i, j = np.nonzero(np.triu(wanted, 1))
    ends = pd.DataFrame({"_tile": np.concatenate([names[i], names[j]]).astype(np.int32), "_pair": np.tile(np.arange(len(i), dtype=np.int64), 2),
                         "_first": np.repeat([True, False], len(i))})
    ends = placed.sparkSession.createDataFrame(ends, "_tile int, _pair long, _first boolean")
    return placed.join(F.broadcast(ends), "_tile")  # pairs of tiles only
