"""Custom distributed operators against brute force on small fixtures and
their invariants (partitioning, planted outliers, merge heights)."""

import numpy as np
import pandas as pd

from featurelens.operators import blocks
from featurelens.operators.cluster import kmeans
from featurelens.operators.density import dbscan
from featurelens.operators.forest import isolation_forest
from featurelens.operators.hierarchy import agglomerative, merge_tree
from featurelens.operators.quality import silhouette
from featurelens.operators.similarity import diversity, knn_all


def brute_dbscan(x, eps, ms):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= ms
    lab = -np.ones(len(x), int)
    c = 0
    for i in range(len(x)):
        if not core[i] or lab[i] != -1:
            continue
        stack, lab[i] = [i], c
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in np.flatnonzero(near[j]):
                if lab[k] == -1:
                    lab[k] = c
                    stack.append(k)
        c += 1
    return lab


def _points(n=400, seed=0):
    rng = np.random.default_rng(seed)
    dense = rng.normal(0, 0.05, size=(n // 2, 2))                  # one hot cell region
    chain = np.c_[np.linspace(2, 4, n // 4), np.zeros(n // 4)]     # a long thin chain
    noise = rng.uniform(-3, 5, size=(n - n // 2 - n // 4, 2))
    return np.vstack([dense, chain, noise])


def test_dbscan_equals_brute_force_with_tiny_blocks(spark):
    x = _points()
    pdf = pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]})
    df = spark.createDataFrame(pdf)
    want = brute_dbscan(x, 0.1, 3)
    for block_rows, parts, dense in ((16, 3, None), (1024, 7, None), (16, 4, False), (1024, 2, True)):
        got = dbscan(df.repartition(parts), "id", ["a", "b"], eps=0.1, min_samples=3, block_rows=block_rows,
                     dense_cells=dense)
        got = got.toPandas().sort_values("id")["cluster"].to_numpy()
        assert (got == want).all()


def test_dense_cells_linked_by_inner_rows_only(spark):
    """Hot cells, some of whose outermost points are apart while other rows are near, and rows without a place."""
    rng = np.random.default_rng(2)
    hot = np.concatenate([rng.uniform(0, 1, (900, 2)) * (0.06, 0.2) + c for c in ((0, 0), (0.155, 0.0), (0.5, 0.5))])
    x = np.concatenate([hot, rng.uniform(-0.5, 1.2, (150, 2)), np.zeros((40, 2))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(5000, None, 0.0), (5001, float("nan"), 0.0), (5002, None, 0.0), (5003, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(5)
    for eps, ms in ((0.1, 4), (0.0955, 3), (0.03, 8)):
        got = dbscan(df, "id", ["a", "b"], eps, ms).toPandas().sort_values("id")["cluster"].to_numpy()
        assert (got == np.concatenate([brute_dbscan(x, eps, ms), [-1] * 4])).all()


def test_streamed_rows_meet_every_block_once_and_few_copies_are_made(spark):
    """Blocks of a large table hold many rows, so that a row is sent to few of them; near rows far from the origin keep their distances."""
    from featurelens.operators.embed import knn_distances

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (150, 4)), 1e4 + rng.normal(0, 1e-3, (60, 4)), np.full((12, 4), 3.0)])
    pdf = pd.DataFrame({"id": np.arange(len(x)), "v": list(x), "l": np.arange(len(x)) % 3})
    df = spark.createDataFrame(pdf).repartition(4)
    both, strips = blocks.streamed(df.select("id"), "id", 100_000)
    assert strips == 1 and both.where("NOT _host").count() == len(x) * 24 and both.where("_host").count() == len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r["id"], r["nbr"]): r["dist"] for r in knn_distances(df, "id", "v", 5, block_rows=40).collect()}
    np.fill_diagonal(d, np.inf)
    assert len(got) == 5 * len(x)
    for i in range(len(x)):
        want = sorted(range(len(x)), key=lambda j: (d[i, j], j < i, j))[:5]
        assert {j for a, j in got if a == i} == set(want)
    assert all(got[k] == d[k] or abs(got[k] - d[k]) < 1e-12 for k in got)


def test_merge_heights_equal_brute_force():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2))
    for link in ("ward", "average", "complete", "single"):
        m = merge_tree(x, np.ones(30), link)
        cl = [[i] for i in range(30)]
        hs = []
        while len(cl) > 1:
            best = None
            for i in range(len(cl)):
                for j in range(i + 1, len(cl)):
                    a, b = x[cl[i]], x[cl[j]]
                    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
                    if link == "single":
                        v = d.min()
                    elif link == "complete":
                        v = d.max()
                    elif link == "average":
                        v = d.mean()
                    else:
                        v = np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(a.mean(0) - b.mean(0))
                    if best is None or v < best[0]:
                        best = (v, i, j)
            v, i, j = best
            hs.append(v)
            cl[i] = cl[i] + cl[j]
            del cl[j]
        assert np.allclose(sorted(hs), sorted(h for _, _, h in m))


def _blobs(spark, seed=5):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    x = np.vstack([c + rng.normal(0, 0.5, size=(60, 2)) for c in centres])
    truth = np.repeat([0, 1, 2], 60)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(180), "a": x[:, 0], "b": x[:, 1]})), truth


def test_agglomerative_and_kmeans_recover_blobs(spark):
    df, truth = _blobs(spark)
    for res in (agglomerative(df, "id", ["a", "b"], k=3, micro_clusters=30), kmeans(df, "id", ["a", "b"], k=3, n_init=3)):
        got = res.toPandas().sort_values("id")["cluster"].to_numpy()
        assert (got == truth).all()                          # numbered by smallest member id


def test_isolation_forest_properties(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    x[17] = [12.0, -12.0, 12.0]                              # planted extreme row
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    r1 = isolation_forest(df, "id", ["a", "b", "c"], n_trees=50, contamination=0.05).toPandas().sort_values("id")
    r2 = isolation_forest(df.repartition(5), "id", ["a", "b", "c"], n_trees=50,
                          contamination=0.05).toPandas().sort_values("id")
    assert int(r1.anomaly_score.idxmin()) == 17
    assert abs((r1.outlier_label == -1).mean() - 0.05) < 0.01
    assert np.allclose(r1.raw_score.to_numpy(), r2.raw_score.to_numpy())


def test_blocked_knn_and_silhouette_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 4))
    lab = rng.integers(0, 3, 150)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(150), "v": list(x), "l": lab}))
    got = knn_all(df, "id", "v", k=3, block_rows=32).toPandas()
    u = blocks.unit_rows(x)
    s = blocks.rounded(u @ u.T, 6)
    np.fill_diagonal(s, -np.inf)
    for i in range(150):
        order = sorted(range(150), key=lambda j: (-s[i, j], j))[:3]
        assert got[got.id == i].sort_values("rank").nbr.tolist() == order
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sil = []
    for i in range(150):
        own = lab == lab[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        sil.append((b - a) / max(a, b))
    got_s = silhouette(df, "id", ["l"], "v", block_rows=40).first()["silhouette"]
    assert abs(got_s - round(float(np.mean(sil)), 4)) < 1e-9


def test_diversity_closed_form_equals_pairs(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 5))
    x[3] = 0.0                                               # a zero vector
    df = spark.createDataFrame(pd.DataFrame({"v": list(x)}))
    u = blocks.unit_rows(x)
    sims = u @ u.T
    iu = np.triu_indices(120, 1)
    want = round(float((1 - sims[iu]).mean()), 4)
    assert diversity(df, "v").first()["diversity"] == want


def test_agglomerative_from_few_micro_clusters(spark):
    df, truth = _blobs(spark)
    got = agglomerative(df, "id", ["a", "b"], k=3, micro_clusters=40).toPandas().sort_values("id")["cluster"].to_numpy()
    assert (got == truth).all()                              # 40 k-means micro-clusters, then ward merges


def test_ward_of_rows_equals_greedy_merging(spark):
    from featurelens.operators.hierarchy import cut_by_heights, ward_rows

    rng = np.random.default_rng(14)
    x = np.vstack([rng.normal(size=(150, 2)), rng.uniform(-9, 9, size=(40, 2))])
    x = np.vstack([x, x[:5], x[:1]])                         # equal rows
    want = cut_by_heights(len(x), merge_tree(x, np.ones(len(x)), "ward"), 70)
    first = {r: i for i, r in reversed(list(enumerate(want)))}
    order = {r: i for i, r in enumerate(sorted(first, key=first.get))}
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    for parts, one_task in ((3, 30), (5, 1000)):
        got = ward_rows(df.repartition(parts), "id", ["a", "b"], k=70, block_rows=64, one_task=one_task)
        got = got.toPandas().sort_values("id")["cluster"].to_numpy()
        assert (got == [order[r] for r in want]).all()       # 70 clusters, more than any fixed 60 centres


def test_kmeans_is_identical_under_repartitioning(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "a": x[:, 0], "b": x[:, 1]}))
    a = kmeans(df.repartition(1), "id", ["a", "b"], k=4, n_init=3).toPandas().sort_values("id")["cluster"].to_numpy()
    b = kmeans(df.repartition(6), "id", ["a", "b"], k=4, n_init=3).toPandas().sort_values("id")["cluster"].to_numpy()
    assert (a == b).all()


def test_embedding_is_identical_under_repartitioning(spark):
    from featurelens.operators.embed import embed_2d

    rng = np.random.default_rng(10)
    x = rng.normal(size=(120, 6))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "v": list(x)}))
    a = embed_2d(df.repartition(1), "id", "v", n_neighbors=6, n_epochs=4).toPandas().sort_values("id")
    b = embed_2d(df.repartition(5), "id", "v", n_neighbors=6, n_epochs=4).toPandas().sort_values("id")
    assert np.array_equal(a[["umap_x", "umap_y"]].to_numpy(), b[["umap_x", "umap_y"]].to_numpy())


def test_pca_equals_numpy(spark):
    from featurelens.operators.features import pca

    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(200), **{f"c{i}": x[:, i] for i in range(4)}}))
    coords, ratio, vecs = pca(df, [f"c{i}" for i in range(4)], k=2)
    xc = x - x.mean(axis=0)
    vals, v = np.linalg.eigh(np.cov(xc, rowvar=False))
    order = np.argsort(vals)[::-1]
    assert np.allclose(ratio, (vals[order] / vals.sum())[:2], atol=1e-9)
    got = coords.toPandas().sort_values("row_id")[["pc1", "pc2"]].to_numpy()
    want = xc @ v[:, order[:2]]
    for j in range(2):                                        # same axis up to the sign convention
        assert np.allclose(np.abs(got[:, j]), np.abs(want[:, j]), atol=1e-8)
        big = np.argmax(np.abs(vecs[:, j]))
        assert vecs[big, j] > 0                               # largest loading is positive
