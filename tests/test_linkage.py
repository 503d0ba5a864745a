"""Linkages of the rows themselves, and the embedding's parts, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurelens.operators import embed, hierarchy


def _plain(x, k, linkage):
    """Greedy merging of all rows: a cluster number per row, numbered by the smallest member."""
    groups = [[i] for i in range(len(x))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    of = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
    while len(groups) > k:
        best = min(((of(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    out = np.empty(len(x), int)
    for number, members in enumerate(sorted(groups, key=min)):
        out[members] = number
    return out


@pytest.mark.parametrize("linkage", ["single", "average", "complete"])
def test_linkage_of_rows_equals_greedy_merging(spark, linkage):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.6, size=(18, 2)) for c in ((0, 0), (3, 1), (0, 4))] + [[[9.0, 9.0]] * 3])
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0), (901, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumns({"_c": F.lit(1), "lo": F.lit(1)})
    options = {"block_rows": 30} | ({"one_task": 25} if linkage != "single" else {})
    found = hierarchy.linkage_rows(df.repartition(3), "id", ["a", "b"], 4, linkage, **options).toPandas().sort_values("id")
    assert found["id"].tolist() == list(range(len(x)))
    np.testing.assert_array_equal(found["cluster"].to_numpy(), _plain(x, 4, linkage))


def test_spanning_tree_of_a_chain_takes_few_rounds(spark, monkeypatch):
    """Distances that grow along a line: nearest-pair merging takes a round a point, Boruvka one in all."""
    rounds = []
    plain = hierarchy._roots
    monkeypatch.setattr(hierarchy, "_roots", lambda chosen: rounds.append(1) or plain(chosen))
    points = spark.createDataFrame([(i, [1.2 ** i]) for i in range(60)], "_c long, _x array<double>")
    tree = hierarchy.spanning_tree(points, block_rows=16).collect()
    assert sorted((r["lo"], r["hi"]) for r in tree) == [(i, i + 1) for i in range(59)]
    assert len(rounds) <= 6


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_few_pairs_of_clusters_are_measured_and_the_nearest_are_among_them(spark, linkage):
    """Neither a table of all pairs of rows nor one of all pairs of clusters."""
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 30, (240, 2))
    of = np.concatenate([np.arange(80), rng.integers(0, 80, 160)])  # clusters of several points, some of one
    x = x[of % 80] + rng.normal(0, 0.5, x.shape)
    w = rng.integers(1, 4, len(x))
    members = spark.createDataFrame([(i, int(w[i]), x[i].tolist(), int(of[i])) for i in range(len(x))], "_c long, _n long, _x array<double>, _k long")
    found = {(r["lo"], r["hi"]): r["d2"] for r in hierarchy._near_pairs(members.repartition(4), linkage, 16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    every = np.full((80, 80), np.inf)
    for a in range(80):
        for b in range(80):
            if a != b:
                part, weight = d[np.ix_(of == a, of == b)], np.outer(w[of == a], w[of == b])
                every[a, b] = part.max() if linkage == "complete" else (part * weight).sum() / weight.sum()
    for a in range(80):
        b = int(every[a].argmin())
        assert abs(found[min(a, b), max(a, b)] - every[a, b]) < 1e-9
    assert all(abs(v - every[k]) < 1e-9 for k, v in found.items())
    assert len(found) < 80 * 79 / 2 / 3


def test_spanning_tree_from_few_candidate_edges(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.4, (90, 2)) for c in ((0, 0), (6, 1), (2, 9))] + [np.stack(np.meshgrid(range(7), range(7)), -1).reshape(-1, 2) + 20.0])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_c long, _x array<double>").repartition(3)
    assert hierarchy._candidate_edges(points, len(x), 24).count() < 12 * len(x)  # all pairs in blocks: far more comparisons than that a round
    d2, i, j = hierarchy._plain_tree(np.arange(len(x)), x)
    want = sorted(zip(d2, np.minimum(i, j), np.maximum(i, j)))
    for few in (20, 100_000):  # with and without rounds
        assert sorted(map(tuple, hierarchy.spanning_tree(points, block_rows=24, few_edges=few).collect())) == want


def test_linkage_of_empty_and_tiny_tables(spark):
    schema = "id long, a double"
    for linkage, rows in (("single", []), ("single", [(4, 1.0), (5, 1.0)]), ("average", []), ("complete", [(4, 1.0), (5, 1.0)])):
        found = hierarchy.linkage_rows(spark.createDataFrame(rows, schema), "id", ["a"], 3, linkage).collect()
        assert sorted((r["id"], r["cluster"]) for r in found) == [(i, 0) for i, _ in rows]
    with pytest.raises(ValueError):
        hierarchy.linkage_rows(spark.createDataFrame([], schema), "id", ["a"], 3, "median")


def test_spectral_start_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    n = 40
    w = np.zeros((n, n))
    part = np.arange(n) % 3  # three groups with weak links between them: two eigenvectors stand out
    for i in range(n):
        for j in range(i):
            w[i, j] = w[j, i] = (1.0 if part[i] == part[j] else 0.05) * (0.5 + rng.random())
    graph = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "i long, j long, w double")
    start = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(n)], "i long, x double, y double")
    found = embed.spectral_start(graph, start, jobs=6, products=6).toPandas().sort_values("i")[["x", "y"]].to_numpy()
    t = np.sqrt(w.sum(axis=1))
    values, vectors = np.linalg.eigh(w / np.outer(t, t))
    basis = vectors[:, -3:-1]
    q, _ = np.linalg.qr(found)
    assert np.linalg.norm(basis @ (basis.T @ q) - q) < 0.05
    assert abs(np.abs(found).max() - 10) < 1e-6


def test_layout_in_several_blocks_is_repeatable_and_moves_less(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(c, 0.3, size=(60, 5)) for c in (0, 4)] + [np.zeros((20, 5))])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": list(x)}))
    options = {"n_neighbors": 8, "n_epochs": 60, "block_rows": 50, "rounds_per_job": 20}
    a = embed.embed_2d(df.repartition(1), "id", "v", **options).toPandas().sort_values("id")[["umap_x", "umap_y"]].to_numpy()
    b = embed.embed_2d(df.repartition(5), "id", "v", **options).toPandas().sort_values("id")[["umap_x", "umap_y"]].to_numpy()
    assert np.array_equal(a, b) and np.isfinite(a).all()
    d = ((a[:, None] - a[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    first, second = np.arange(len(a)) < 60, (np.arange(len(a)) >= 60) & (np.arange(len(a)) < 120)
    near = d.argmin(axis=1)
    assert (second[near[second]]).mean() > 0.95 and (~second[near[first]]).mean() > 0.95


def test_equal_rows_make_a_ring_and_no_hub(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "id long, v array<double>")
    knn = embed.knn_distances(df, "id", "v", 4, block_rows=16)
    assert {r["n"] for r in knn.groupBy("nbr").agg(F.count(F.lit(1)).alias("n")).collect()} == {4}


def test_play_stops_at_the_tolerance(spark):
    graph = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i long, j long, w double")
    start = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0)], "i long, x double, y double")
    found = embed.layout(graph, start, 100, 1.5, 0.9, negatives=0, rounds_per_job=10).collect()
    assert sorted(map(tuple, found)) == [(0, 0.0, 0.0), (1, 0.0, 0.0)]


def test_dominant_labels_with_sentinels(spark):
    from featurelens.operators.profile import cluster_table, dominant_labels

    rows = [(0, "C", "maj", "8B"), (0, "C", "min", "?"), (0, "G", "min", "9B"), (0, "?", "maj", "1A"), (0, None, "maj", "1A"),  # label over rows with a key: min
            (1, "?", "maj", "2A"), (1, None, None, None), (2, "D", None, "?"), (-1, "A", "maj", "3A")]
    df = spark.createDataFrame([(*r, f"n{i}", "x", i) for i, r in enumerate(rows)], "cluster int, key string, mode string, camelot string, name string, artist string, pos int")
    found = {r["cluster"]: (r["dominant_category"], r["dominant_code"]) for r in dominant_labels(df, "cluster", "key", "mode", "camelot").collect()}
    assert found == {0: ("C min", "8B"), 1: ("?", "?"), 2: ("D ?", "?"), -1: ("A maj", "3A")}
    table = cluster_table(df, ["pos"], dominant_of=("key", "mode", "camelot")).collect()
    assert {r["cluster"]: r["dominant_category"] for r in table} == {0: "C min", 1: "?", 2: "D ?"}
    bare = cluster_table(df.where("key = '?' OR key IS NULL"), ["pos"], dominant_of=("key", "mode", "camelot"))
    assert "dominant_category" not in bare.columns
