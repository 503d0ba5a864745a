"""Closed-form silhouette against all pairs; the choice of k."""

import numpy as np
import pytest

from featurelens.operators import quality
from featurelens.operators.cluster import optimal_k


def frame(spark, rows, schema="id long, v array<double>, a long, b long"):
    return spark.createDataFrame(rows, schema)


def brute(x, labels):
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    if len(set(labels)) < 2:
        return None
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = d2[i][same].sum() / (same.sum() - 1)
        b = min(d2[i][labels == c].mean() for c in set(labels) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return round(float(np.mean(scores)), 4)


@pytest.mark.parametrize("block", [1, 2, 256])
def test_squared_silhouette_equals_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(quality, "CLUSTER_BLOCK", block)
    rng = np.random.default_rng(5)
    # far from the origin, where sums of squares would cancel
    x = rng.normal(size=(120, 3)) + 1e5
    a, b = rng.integers(0, 5, 120), np.where(np.arange(120) == 7, -1, 0)
    x[a == 2] += 4
    df = frame(spark, [(i, [float(c) for c in x[i]], int(a[i]), int(b[i])) for i in range(120)])
    got = {r["labelling"]: r["silhouette_squared"] for r in quality.silhouette_squared(df.repartition(5), "id", ["a", "b"], "v").collect()}
    assert got == {"a": pytest.approx(brute(x, a), abs=1e-4), "b": pytest.approx(brute(x, b), abs=1e-4)}


def test_squared_silhouette_edges(spark):
    one = frame(spark, [(1, [0.0], 0, None), (2, [1.0], 0, None), (3, None, 1, 1), (None, [4.0], 1, 1)])
    got = {r["labelling"]: r["silhouette_squared"] for r in quality.silhouette_squared(one, "id", ["a", "b"], "v").collect()}
    assert got == {"a": None, "b": None}
    none = quality.silhouette_squared(frame(spark, []), "id", ["a"], "v").collect()
    assert [tuple(r) for r in none] == [("a", None)]
    equal = frame(spark, [(i, [2.0, 2.0], i % 2, 0) for i in range(6)])
    assert quality.silhouette_squared(equal, "id", ["a"], "v").first()["silhouette_squared"] == 0.0


@pytest.mark.parametrize("measure", ["silhouette", "silhouette_squared"])
def test_best_k_is_the_first_of_the_highest(spark, measure):
    rng = np.random.default_rng(2)
    rows = [(i, *(float(c) for c in rng.normal(size=2) * 0.1 + 10 * np.array([i % 3, (i % 3) ** 2]))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    res = optimal_k(df, "id", ["x", "y"], range(2, 5), n_init=4, measure=measure).collect()
    top = max(r[measure] for r in res)
    assert [r["k"] for r in res if r["best"]] == [min(r["k"] for r in res if r[measure] == top)] == [3]
    # two points twice: k = 2 and more all have the same clusters
    tied = spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(8)], "id long, x double, y double")
    res = optimal_k(tied, "id", ["x", "y"], range(2, 4), n_init=1, measure=measure).collect()
    assert [r["k"] for r in res if r["best"]] == [2]
    with pytest.raises(ValueError):
        optimal_k(df, "id", ["x", "y"], measure="dunn")
