"""The bisecting tree against a plain version of its rule."""

import numpy as np
import pytest

from featurelens.operators.bisecting import bisecting_tree


def frame(spark, vectors, schema="id long, v array<double>"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], schema)


def plain(x, k, max_iter=20):
    """Levels of 2-means splits, the widest sums of squares first."""
    def sse(m):
        return ((x[m] - x[m].mean(axis=0)) ** 2).sum()

    leaves = [np.arange(len(x))]
    while len(leaves) < k:
        chosen = sorted((i for i in range(len(leaves)) if sse(leaves[i]) > 1e-12), key=lambda i: -sse(leaves[i]))[:k - len(leaves)]
        if not chosen:
            break
        grown = []
        for i, m in enumerate(leaves):
            if i not in chosen:
                grown.append(m)
                continue
            p = x[m]
            j = p.var(axis=0).argmax()
            side = p[:, j] > p[:, j].mean()
            for _ in range(max_iter):
                a, b = p[~side].mean(axis=0), p[side].mean(axis=0)
                new = ((p - b) ** 2).sum(axis=1) < ((p - a) ** 2).sum(axis=1)
                if (new == side).all():
                    break
                side = new
            grown += [m[~side], m[side]]
        leaves = grown
    out = np.zeros(len(x), int)
    for c, m in enumerate(sorted(leaves, key=min)):
        out[m] = c
    return list(out)


def answer(labels):
    return [r["cluster"] for r in sorted(labels.collect(), key=lambda r: r["id"])]


@pytest.mark.parametrize("k", [5, 8])
def test_equals_the_plain_rule_however_partitioned(spark, k):
    rng = np.random.default_rng(k)
    middle = rng.normal(size=(8, 4)) * 20
    # a third of the rows is one point
    x = np.vstack([middle[rng.integers(0, 8, 160)] + rng.normal(size=(160, 4)), np.full((80, 4), 7.25)])
    df = frame(spark, x)
    labels, nodes = bisecting_tree(df, "id", "v", k)
    got = answer(labels)
    assert got == plain(x, k)
    assert answer(bisecting_tree(df.repartition(11), "id", "v", k)[0]) == got
    rows = {r["node"]: r for r in nodes.collect()}
    assert len(rows) == 2 * k - 1 and sum(r["leaf"] for r in rows.values()) == k
    assert sum(r["n"] for r in rows.values() if r["leaf"]) == len(x)
    assert rows[0]["sse"] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum(), rel=1e-5)
    for r in rows.values():
        if r["parent"] is not None:
            assert r["sse"] < rows[r["parent"]]["sse"] and r["level"] > rows[r["parent"]]["level"]


def test_edges(spark):
    few = frame(spark, [[1, 1]] * 5 + [[2, 2]] * 3 + [None, [float("nan"), 0]])
    labels, nodes = bisecting_tree(few, "id", "v", 6)
    assert answer(labels) == [0] * 5 + [1] * 3 and nodes.count() == 3
    assert answer(bisecting_tree(few, "id", "v", 1)[0]) == [0] * 8
    assert answer(bisecting_tree(frame(spark, [[0, 0]] * 3), "id", "v", 4)[0]) == [0] * 3
    labels, nodes = bisecting_tree(frame(spark, []), "id", "v", 3)
    assert labels.count() == nodes.count() == 0
    with pytest.raises(ValueError):
        bisecting_tree(few, "id", "v", 0)
