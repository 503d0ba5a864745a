"""Pruned nearest neighbours against all pairs."""

import numpy as np
import pytest

from featurelens.operators.density import dbscan, dbscan_vectors
from featurelens.operators.neighbours import METRICS, nearest

from test_models import brute_dbscan


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)], "id long, v array<double>")


def brute(vectors, k, metric):
    x = np.asarray(vectors, dtype=float)
    if metric == "euclidean":
        cost = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    elif metric == "manhattan":
        cost = np.abs(x[:, None] - x[None]).sum(axis=2)
    else:
        norm = np.sqrt((x * x).sum(axis=1))
        u = x / np.where(norm == 0, 1, norm)[:, None]
        cost = -(u @ u.T)
    cost = np.rint(cost * 1e12) / 1e12
    np.fill_diagonal(cost, np.inf)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), cost[i]))[:k]] for i in range(len(x))}


def answer(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["nbr"])
    return out


def clustered(n, d, centres=12, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d)) * 10
    # a third of all rows lies in one spot
    which = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, centres, n))
    return middle[which] + rng.normal(size=(n, d)) * 0.05


@pytest.mark.parametrize("metric", METRICS)
def test_equals_all_pairs(spark, metric):
    uniform = np.random.default_rng(1).random((300, 3)) - 0.5
    for vectors in (clustered(400, 6), uniform):
        got = answer(nearest(frame(spark, vectors), "id", "v", 4, metric, block_rows=32))
        assert got == brute(vectors, 4, metric)


def test_clusters_need_fewer_copies_than_all_cells(spark):
    n, block = 1500, 32
    figures = {}
    vectors = clustered(n, 8, centres=40)
    got = answer(nearest(frame(spark, vectors).repartition(7), "id", "v", 3, "euclidean", block_rows=block, figures=figures))
    assert got == brute(vectors, 3, "euclidean")
    print("copies", figures)
    assert 0 < figures["copies"] < n * n / block


def test_ties_repeated_rows_and_a_far_row(spark):
    vectors = [[1, 1]] * 70 + [[2, 1]] * 5 + [[900, -900]]
    for metric in METRICS:
        assert answer(nearest(frame(spark, vectors), "id", "v", 3, metric, block_rows=8)) == brute(vectors, 3, metric)


def test_zero_vectors_nulls_and_empty_tables(spark):
    vectors = [[0, 0], [1, 0], [0, 0], [-1, 0.1], [1, 0.1]]
    got = nearest(frame(spark, vectors), "id", "v", 2, block_rows=2)
    assert answer(got) == brute(vectors, 2, "cosine")
    low = nearest(frame(spark, vectors), "id", "v", 3, zero_norm=-2.0)
    assert answer(low)[1] == [4, 3, 0] and answer(low)[2] == [0, 1, 3]
    holes = frame(spark, vectors + [None, [float("nan"), 1], [float("inf"), 1]]).unionByName(frame(spark, [[5, 5]]).selectExpr("CAST(NULL AS LONG) AS id", "v"))
    assert answer(nearest(holes, "id", "v", 2, "manhattan")) == brute(vectors, 2, "manhattan")
    assert nearest(frame(spark, []), "id", "v", 2).count() == 0
    assert nearest(frame(spark, [[1, 2]]), "id", "v", 2, "euclidean").count() == 0
    with pytest.raises(ValueError):
        nearest(holes, "id", "v", 0)
    with pytest.raises(ValueError):
        nearest(holes, "id", "v", 1, "hamming")


def labels(df):
    return [r["cluster"] for r in sorted(df.collect(), key=lambda r: r["id"])]


def test_density_clusters_of_wide_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    chain = np.zeros((60, 9))
    chain[:, 4] = 30 + np.arange(60) * 0.09  # one cluster over many rings and parts
    vectors = np.vstack([clustered(200, 9, centres=6), chain, rng.uniform(-15, 15, (25, 9)), np.full((40, 9), 2.5)])
    vectors = vectors[rng.permutation(len(vectors))]
    for block, min_samples in ((16, 3), (64, 5)):
        got = dbscan_vectors(frame(spark, vectors).repartition(6), "id", "v", 0.12, min_samples, block_rows=block, max_pivots=20)
        assert labels(got) == list(brute_dbscan(vectors, 0.12, min_samples))


def test_density_clusters_of_many_columns_and_edges(spark):
    x = clustered(90, 5, centres=4)
    cols = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(1000, None, 0.0, 0.0, 0.0, 0.0)], "id long, " + ", ".join(f"{c} double" for c in cols))
    assert labels(dbscan(df, "id", cols, 0.2, 4, block_rows=32)) == list(brute_dbscan(x, 0.2, 4))
    assert dbscan_vectors(frame(spark, []), "id", "v").count() == 0
    holes = frame(spark, [[0.0, -0.0], [0.0, 0.0], [9, 9], None, [float("nan"), 0]])
    assert labels(dbscan_vectors(holes, "id", "v", 0.1, 2)) == [0, 0, -1]
    with pytest.raises(ValueError):
        dbscan_vectors(holes, "id", "v", 0)


def test_copies_grow_with_the_rows_where_nothing_is_pruned(spark):
    """blocks of a fixed size got n^2 / block rows."""
    vectors = np.random.default_rng(4).normal(size=(2500, 16))
    for metric in ("cosine", "euclidean"):
        figures = {}
        got = answer(nearest(frame(spark, vectors), "id", "v", 3, metric, block_rows=32, figures=figures))
        assert got == brute(vectors, 3, metric)
        assert figures["copies"] < 60 * len(vectors)


def test_closest_by_products_equals_all_pairs():
    """ties, the row itself, limits and values too large for products."""
    from featurelens.operators import neighbours as nb

    rng = np.random.default_rng(2)
    grid = rng.integers(0, 3, (900, 3)) + 1.0
    for x in (grid, grid * 1e200, rng.normal(size=(5000, 5))):
        ids = rng.permutation(len(x))
        for metric in METRICS:
            u = x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" and np.isfinite(np.linalg.norm(x, axis=1)).all() else x
            if metric == "cosine" and u is x or metric == "euclidean" and x.max() > 1e100:
                continue
            guest = slice(0, 60)
            row, nbr, cost = nb._closest(ids[guest], u[guest], ids, u, 4, metric, np.full(60, np.inf))
            want = nb._cost(u[guest], u, metric)
            want[np.arange(60), np.arange(60)] = np.inf
            assert nbr.tolist() == [int(j) for c in want for j in ids[np.lexsort((ids, c))[:4]]]


def test_density_of_one_large_cluster_sends_few_rows(spark):
    """all rows were sent to all parts in reach, twice."""
    rng = np.random.default_rng(5)
    vectors = np.vstack([rng.uniform(0, 1, (1500, 4)), rng.uniform(4, 5, (60, 4)), rng.uniform(-9, 9, (40, 4)), [[20, 0, 0, 0], [20.25, 0, 0, 0], [20.5, 0, 0, 0]]])
    figures = {}
    got = dbscan_vectors(frame(spark, vectors), "id", "v", 0.25, 3, block_rows=32, figures=figures)
    assert labels(got) == list(brute_dbscan(vectors, 0.25, 3))
    print("copies", figures)
    assert 0 < figures["copies"] < 30 * len(vectors)


def test_density_by_products_equals_differences():
    """pairs at the limit are decided by differences."""
    from featurelens.operators import density

    rng = np.random.default_rng(6)
    for x, eps in ((rng.integers(0, 4, (300, 3)) * 0.1 + 50, 0.1), (rng.normal(size=(300, 8)), 2.0), (rng.normal(size=(50, 2)) * 1e200, 1.0)):
        with np.errstate(over="ignore"):
            near = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        near = np.sqrt(near) ** 2 <= eps * eps
        weights = rng.integers(1, 5, len(x))
        assert density._degrees(x, x, weights, eps).tolist() == (near @ weights).tolist()
        parent = density._components(x, eps)
        reach = near.copy()
        for _ in range(9):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        assert parent.tolist() == reach.argmax(axis=1).tolist()
