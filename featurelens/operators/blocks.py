"""Blocked all-pairs work without a cross join and without emitting pairs.

Rows are hashed into ``B = ceil(n / block_rows)`` blocks. Each row is sent
to the ``B`` cells ``(min(b, j), max(b, j))``, so cell ``(i, j)`` holds
exactly blocks ``i`` and ``j`` (at most ~2 * block_rows rows: a bounded
group whatever the key skew, because blocks come from a hash of the row id).
A grouped Pandas function then does the O(|i| * |j|) arithmetic for that
cell with numpy and emits only per-row summaries (top-k lists, per-cluster
distance sums), never the pairs themselves.

``streamed`` needs fewer copies: a task holds one large block, and all rows go
by it as a stream.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelens.session import ensure_code

DEFAULT_BLOCK_ROWS = 2048


def with_cells(df: DataFrame, key: str, n: int, block_rows: int = DEFAULT_BLOCK_ROWS, block: Column | None = None) -> tuple[DataFrame, int]:
    """Add ``_blk`` (the row's block, ``block`` if given) and ``_cell`` (one row per cell it joins)."""
    ensure_code(df.sparkSession)
    nb = max(1, math.ceil(n / block_rows))
    blk = F.pmod(F.xxhash64(F.col(key)), F.lit(nb)) if block is None else block
    other = F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
    out = (df.withColumn("_blk", blk.cast("long"))
           .withColumn("_other", other)
           .withColumn("_cell", F.least("_blk", "_other") * nb + F.greatest("_blk", "_other"))
           .drop("_other"))
    return out, nb


def split_cell(pdf, nb: int):
    """Return (left, right, same_block) frames of one cell."""
    cell = int(pdf["_cell"].iloc[0])
    i, j = divmod(cell, nb)
    left = pdf[pdf["_blk"] == i]
    right = pdf[pdf["_blk"] == j]
    return left, right, i == j


def stack(vectors) -> np.ndarray:
    """Object column of arrays -> 2-D float64 matrix."""
    if len(vectors) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


def euclidean(a: np.ndarray, b: np.ndarray, chunk: int = 128) -> np.ndarray:
    """Exact pairwise Euclidean distances by explicit differences (chunked)."""
    out = np.empty((a.shape[0], b.shape[0]))
    for s in range(0, a.shape[0], chunk):
        diff = a[s:s + chunk, None, :] - b[None, :, :]
        out[s:s + chunk] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def squared_to(b: np.ndarray):
    """Function from rows to their squared distances to the rows ``b`` by one matrix product, and how far they may be off (not finite: of no use)."""
    with np.errstate(over="ignore", invalid="ignore"):
        qb = np.einsum("ij,ij->i", b, b)
        right = np.hstack([-2.0 * b, np.ones((len(b), 1)), qb[:, None]]).T

    def run(a: np.ndarray) -> tuple[np.ndarray, float]:
        with np.errstate(over="ignore", invalid="ignore"):
            qa = np.einsum("ij,ij->i", a, a)
            d2 = np.hstack([a, qa[:, None], np.ones((len(a), 1))]) @ right
            return d2, float(8 * np.finfo(float).eps * (a.shape[1] + 8) * (qa.max(initial=0.0) + qb.max(initial=0.0)))

    return run


def squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and how far they may be off (not finite: of no use)."""
    return squared_to(b)(a)


def between(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray, chunk: int = 50_000) -> np.ndarray:
    """Exact distances of single pairs, by differences."""
    out = np.empty(len(row))
    for s in range(0, len(row), chunk):
        diff = a[row[s:s + chunk]] - b[col[s:s + chunk]]
        out[s:s + chunk] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances with a relative error of 1e-9 at most; those of near rows are by differences."""
    d2, error = squared(a, b)
    near = d2 <= 1e9 * error
    if not np.isfinite(error) or near.sum() > near.size / 10:
        return euclidean(a, b, max(1, 2_000_000 // max(1, b.size)))
    row, col = np.nonzero(near)
    d2[row, col] = 0.0
    out = np.sqrt(d2)
    out[row, col] = between(a, b, row, col)
    return out


HOST_ROWS = 32_768      # rows of a block that a task holds
HOST_BLOCKS = 24        # blocks wanted for a small table, so that tasks have company
LEAST_ROWS = 512
STRIP_ROWS = 400_000    # rows that go by a block in one task


def streamed(df: DataFrame, key: str, n: int, block_rows: int | None = None) -> tuple[DataFrame, int]:
    """Every block of rows (``_host``), followed by all rows in strips, sorted so that a task reads them as a stream.

    A row is sent once to each block; a task holds a block and a batch. Returns the
    rows with ``_blk``, ``_strip`` and ``_host``, and the number of strips.
    """
    ensure_code(df.sparkSession)
    rows = block_rows or min(HOST_ROWS, max(LEAST_ROWS, math.ceil(n / HOST_BLOCKS)))
    nb, strips = max(1, math.ceil(n / rows)), max(1, math.ceil(n / STRIP_ROWS))
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    hosts = df.withColumn("_blk", F.pmod(F.xxhash64(key), F.lit(nb)).cast("int")).withColumn("_strip", upto(strips)).withColumn("_host", F.lit(True))
    guests = df.withColumn("_blk", upto(nb)).withColumn("_strip", F.pmod(F.xxhash64(F.lit(5), F.col(key)), F.lit(strips)).cast("int")).withColumn("_host", F.lit(False))
    # more partitions than groups, so that few groups share one
    both = hosts.unionByName(guests).repartition(min(4096, 8 * nb * strips), "_blk", "_strip")
    return both.sortWithinPartitions("_blk", "_strip", F.desc("_host")), strips


def each_block(batches, start, feed, finish):
    """Run over ``streamed`` rows: ``start(host rows)`` gives a state, ``feed(state, rows)`` takes the others, ``finish(state)`` gives frames."""
    name, hosts, state = None, [], None
    for pdf in batches:
        tags = np.stack([pdf[c].to_numpy().astype(np.int64) for c in ("_blk", "_strip", "_host")], axis=1)
        ends = np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *ends], [*ends, len(pdf)]):
            if s == e:
                continue
            part, of = pdf.iloc[s:e], (tags[s, 0], tags[s, 1])
            if of != name:
                if state is not None:
                    yield from finish(state)
                name, hosts, state = of, [], None
            if tags[s, 2]:
                hosts.append(part)
                continue
            if state is None and hosts:
                state, hosts = start(hosts), []
            if state is not None:
                feed(state, part)
    if state is not None:
        yield from finish(state)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; zero rows stay zero."""
    nrm = np.sqrt((m * m).sum(axis=1))
    safe = np.where(nrm == 0, 1.0, nrm)
    return m / safe[:, None]


def rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """Same rounding as ``functions.rnd(x, decimals)``: half-even on the scaled value."""
    return np.rint(x * 10.0 ** decimals) / 10.0 ** decimals
