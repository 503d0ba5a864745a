"""Whitening of vectors by the leading eigenvectors of their covariance (operator 11).

Entries become whole numbers, so counts, sums and deviations are exact. The
covariance matrix is never formed: Jacobi-Davidson asks for its product with a
few vectors at a time, which one pass over the rows answers; every task centres
its rows and sends back one small partial sum.

Each round has a subspace with a Rayleigh-Ritz step; pairs whose residual is at
the rounding of doubles are locked, all others get a correction: the equation
``(I - QQ')(V - theta I)(I - QQ') t = -r`` is solved roughly by a few MINRES
steps, for all pairs at once (one pass a step), and widens the subspace. It is
cut back to the leading Ritz vectors when it reaches ``max_basis``.

The driver holds the subspace and its image (dimension x ``max_basis`` numbers,
whatever the number of rows) and one partial sum for each of about the square
root of the partitions.

Defined results: rows whose vector is null, empty, or has null or non-finite
entries are dropped, and so are vectors of another length than most have (of
equally frequent lengths the longest counts). Components whose eigenvalue is
nothing but rounding are left out, so a table whose vectors span fewer
dimensions has fewer; one without spread, or without rows, gives an empty
result. Null ids and repeated rows are rows like others. ``deviation`` is null
where it exceeds a long. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm.staging import prepare
from featurelens.session import shared_dir

EPS = float(np.finfo(np.float64).eps)
FEW_PARTS = 64
OUT_ROWS = 2_048


@dataclass
class Components:
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column each
    residuals: np.ndarray  # norms
    rounds: int
    products: int


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Rough solutions of symmetric systems, a column each, that advance together."""
    x, w, w_before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    r_before, r = b, b
    beta = np.linalg.norm(b, axis=0)
    beta_before, dbar, epsilon, phi_bar = np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    cosine, sine = -np.ones_like(beta), np.zeros_like(beta)
    floor = EPS * np.maximum(beta, np.finfo(float).tiny)
    open_ = beta > 0
    for step in range(steps):
        v = np.where(open_, r / np.where(open_, beta, 1), 0)
        y = apply(v)
        if step:
            y = y - beta / beta_before * r_before
        alpha = (v * y).sum(axis=0)
        y = y - alpha / np.where(open_, beta, 1) * r
        r_before, r = r, y
        beta_before, beta = np.where(open_, beta, 1), np.linalg.norm(y, axis=0)
        epsilon_before, delta = epsilon, cosine * dbar + sine * alpha
        gamma_bar = sine * dbar - cosine * alpha
        epsilon, dbar = sine * beta, -cosine * beta
        gamma = np.maximum(np.hypot(gamma_bar, beta), np.finfo(float).tiny)
        cosine, sine = gamma_bar / gamma, beta / gamma
        phi, phi_bar = cosine * phi_bar, sine * phi_bar
        w_before, w = w, (v - epsilon_before * w_before - delta * w) / gamma
        x = x + np.where(open_, phi * w, 0)
        open_ &= beta > floor
        if not open_.any():
            break
    return x


def _orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``t`` adds to orthonormal ``bases``."""
    norms = np.linalg.norm(t, axis=0)
    t = t[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        for q in bases:
            t = t - q @ (q.T @ t)
        if not t.shape[1]:
            return t
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-8]
    return t


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dimension: int, k: int, max_basis: int | None = None, inner: int = 4,
                    seed: int = 17, rounds: int = 200) -> Components:
    """The ``k`` largest eigenpairs of a symmetric positive semidefinite operator, to double precision.

    A pair is locked when its residual is below ``4 * sqrt(dimension)`` roundings of the
    largest eigenvalue, or as low as it gets: when it is below 10^-12 of that and
    three rounds in a row have not halved it.
    """
    k = min(k, dimension)
    width = min(dimension, k + 4)
    limit = min(dimension, max(max_basis or 3 * k, width + k))
    asked = 0

    def image(block: np.ndarray) -> np.ndarray:
        nonlocal asked
        asked += 1
        return product(block)

    locked, lock_values = np.zeros((dimension, 0)), np.zeros(0)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dimension, width)))
    mapped = image(basis)
    best, stale = math.inf, 0
    for turn in range(1, rounds + 1):
        small = basis.T @ mapped
        theta, rotate = np.linalg.eigh((small + small.T) / 2)
        theta, rotate = theta[::-1], rotate[:, ::-1]
        basis, mapped = basis @ rotate, mapped @ rotate
        wanted = k - locked.shape[1]
        largest = max(theta[0] if len(theta) else 0.0, lock_values.max(initial=0.0), np.finfo(float).tiny)
        residual = mapped[:, :wanted] - basis[:, :wanted] * theta[:wanted]
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        worst = float(norms.max(initial=0.0))
        best, stale = (worst, 0) if worst < best / 2 else (best, stale + 1)
        whole = basis.shape[1] + locked.shape[1] >= dimension  # nothing is left to add
        done = (norms <= 4 * math.sqrt(dimension) * EPS * largest) | (norms <= 1e-12 * largest) & (whole | (stale >= 3))
        take = int(np.argmin(done)) if not done.all() else len(done)  # leading pairs only
        if take:
            locked, lock_values = np.concatenate([locked, basis[:, :take]], axis=1), np.concatenate([lock_values, theta[:take]])
            basis, mapped, theta, residual = basis[:, take:], mapped[:, take:], theta[take:], residual[:, take:]
            best, stale = math.inf, 0
        if locked.shape[1] >= k:
            break
        open_ = residual.shape[1]
        if basis.shape[1] + open_ > limit - locked.shape[1] and not whole:
            keep = max(open_ + 4, limit - locked.shape[1] - open_) if limit - locked.shape[1] > 2 * open_ else open_
            basis, mapped, theta = basis[:, :keep], mapped[:, :keep], theta[:keep]
        if whole or turn % 8 == 0:  # images drift from what they stand for as they are rotated
            basis = _orthonormal(basis, locked)
            mapped = image(basis)
            continue
        close = np.concatenate([locked, basis[:, :open_]], axis=1)
        shift = theta[:open_]

        def corrected(v: np.ndarray) -> np.ndarray:
            v = v - close @ (close.T @ v)
            y = image(v) - v * shift
            return y - close @ (close.T @ y)

        t = minres(corrected, -(residual - close @ (close.T @ residual)), inner)
        new = _orthonormal(t, locked, basis)
        if not new.shape[1]:
            fresh = np.random.default_rng(seed + turn).standard_normal((dimension, max(1, min(open_, dimension - basis.shape[1] - locked.shape[1]))))
            new = _orthonormal(fresh, locked, basis)
        basis, mapped = np.concatenate([basis, new], axis=1), np.concatenate([mapped, image(new)], axis=1)
    else:
        raise RuntimeError(f"{locked.shape[1]} of {k} components settled in {rounds} rounds")
    q, _ = np.linalg.qr(locked)
    mapped = image(q)
    theta, rotate = np.linalg.eigh((q.T @ mapped + mapped.T @ q) / 2)
    order = np.argsort(-theta, kind="stable")
    vectors = q @ rotate[:, order]
    return Components(theta[order], vectors, np.linalg.norm(mapped @ rotate[:, order] - vectors * theta[order], axis=0), turn, asked)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimension)


class Table:
    """Whole-number vectors in the shared folder, with what passes over them give."""

    def __init__(self, rows: DataFrame, n: int, dimension: int):
        self.rows, self.n, self.dimension = rows, n, dimension
        self.partitions = rows.rdd.getNumPartitions() if n else 0
        self.sums = np.zeros(dimension, np.int64)
        if n:
            self.sums = self._total(lambda x: x.sum(axis=0), np.int64)

    def _total(self, of: Callable[[np.ndarray], np.ndarray], dtype: type) -> np.ndarray:
        """Sum over all rows of a small array per batch; partial sums are added in the order of partitions."""
        dimension = self.dimension
        buckets = max(1, math.isqrt(self.partitions))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    found = of(_matrix(batch.column("x"), dimension))
                    total = found if total is None else total + found
            if total is not None:
                number = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([number % buckets], pa.int32()), pa.array([number], pa.int32()),
                                                  pa.array([np.ascontiguousarray(total, dtype).tobytes()], pa.binary())], names=["bucket", "part", "sums"])

        def added(rows: list[tuple[int, bytes]]) -> np.ndarray:
            total = 0
            for _, sums in sorted(rows):
                total = total + np.frombuffer(sums, dtype)
            return total

        def merge(table: pa.Table) -> pa.Table:
            numbers = table.column("part").to_pylist()
            total = added(list(zip(numbers, table.column("sums").to_pylist())))
            return pa.table({"part": pa.array([min(numbers)], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        parts = self.rows.select("x").mapInArrow(part, "bucket int, part int, sums binary")
        if self.partitions > FEW_PARTS:
            parts = parts.groupBy("bucket").applyInArrow(merge, "part int, sums binary")
        return added([(r["part"], r["sums"]) for r in parts.select("part", "sums").collect()])  # the square root of the partitions

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows less the mean, by whole numbers up to the division."""
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums) / n

    def trace(self) -> float:
        centre = self.centred()
        return float(self._total(lambda x: np.array([np.square(centre(x)).sum()]), np.float64)[0]) / self.n

    def product(self, block: np.ndarray) -> np.ndarray:
        """Covariance times a block of vectors: one pass over the rows."""
        centre = self.centred()

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ block)

        return self._total(part, np.float64).reshape(block.shape) / self.n

    def identity_error(self, weights: np.ndarray) -> float:
        """Largest absolute entry of the whitened rows' covariance less the identity."""
        centre, k = self.centred(), weights.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            z = centre(x) @ weights
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        found = self._total(part, np.float64) / self.n
        mean = found[:k]
        return float(np.abs(found[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(_id, x): vectors without null or non-finite entries as whole numbers."""
    entry = F.col(vector_col).cast("array<double>")
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = df.select(F.col(id_col).alias("_id"), entry.alias("_v")).where(F.col("_v").isNotNull() & (F.size("_v") > 0) & finite)
    return rows.select("_id", F.transform("_v", lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums over dimensions of (n * x - S)^2 as longs, null beyond them."""
    away = n * x - sums
    if not len(away) or int(np.abs(away).max()) ** 2 * x.shape[1] < 1 << 63:
        return pa.array(np.square(away).sum(axis=1))
    found = [sum(int(v) ** 2 for v in row) for row in away]
    return pa.array([v if v < 1 << 63 else None for v in found], pa.int64())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 32, scale: int = 64, offset: int = 1_000_000,
           max_basis: int | None = None, inner: int = 4) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained and identity_error."""
    if k < 1:
        raise ValueError(f"k must be 1 or more: {k}")
    spark = df.sparkSession
    prepare(spark)
    path = shared_dir(spark, "whole-vectors")
    whole_vectors(df, id_col, vector_col, scale, offset).withColumn("length", F.size("x")).write.parquet(path)
    stored = spark.read.parquet(path)
    usual = stored.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    dimension, n = (usual["length"], usual["count"]) if usual else (1, 0)
    rows = stored.where(F.col("length") == dimension).select("_id", "x")
    table = Table(rows, n, dimension)
    sums = table.sums
    weights, explained, error = np.zeros((dimension, 0)), np.zeros(0), 0.0
    trace = table.trace() if n else 0.0
    if trace > 0:
        found = jacobi_davidson(table.product, dimension, k, max_basis, inner)
        real = found.values > dimension * 16 * EPS * found.values[0]
        weights = found.vectors[:, real] / np.sqrt(found.values[real])
        explained = found.values[real] / trace
        error = table.identity_error(weights)
    kept, centre = weights.shape[1], table.centred() if n else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if kept else 0, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                x = _matrix(part.column("x"), dimension)
                rows_of = pa.array(np.repeat(np.arange(len(x)), kept))
                z = centre(x) @ weights
                yield pa.RecordBatch.from_arrays([
                    part.column("_id").take(rows_of), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * kept, n, np.int64)), _deviations(x, n, sums).take(rows_of), pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * kept, error))],
                    names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    found = rows.mapInArrow(run, f"_id {stored.schema['_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return found.withColumnRenamed("_id", id_col)
