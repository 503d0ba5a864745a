"""Rules that the catalogue's tables don't reach: near ties, empty wrappers, null keys, repeated pages."""

import pytest
from pyspark.sql import functions as F

from featurelens.operators.positions import batch_numbers, dense_index
from featurelens.operators.similarity import knn_all, representatives, similar_to
from featurelens.session import shared_dir
from featurelens.sources import json_scan


def test_near_ties_rank_by_the_similarity_itself(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 4e-4], 1), (2, [1.0, 1e-4], 1)], "id long, v array<double>, g int")
    assert [r["id"] for r in similar_to(df, "id", "v", 0, 2).orderBy("rank").collect()] == [2, 1]
    assert knn_all(df, "id", "v", 1).where("id = 0").first()["nbr"] == 2
    two = spark.createDataFrame([(7, [1.0, 0.0], 1), (8, [1.0, 3e-4], 1), (9, [1.0, 1e-4], 1)], "id long, v array<double>, g int")
    assert representatives(two, "g", "id", "v").first()["representative"] == 9


def test_empty_wrapper_falls_through(spark):
    page = '{"items": [{"item": {}, "track": {"id": "a", "type": "track"}}, {"item": {"id": "b", "type": "track"}}, {"track": null}, {"item": {}}]}'
    pages = spark.createDataFrame([(0, page)], "page_no long, p string").select("page_no", F.from_json("p", json_scan.PAGE)["items"].alias("items"))
    assert [r["t"]["id"] for r in json_scan.page_items(pages).orderBy("item_pos").collect()] == ["a", "b"]


def test_last_page_of_an_artist_wins(spark):
    pages = spark.createDataFrame([(1, [("x", ["new"]), None, ("y", None)]), (0, [("x", ["old"]), ("y", ["z"])])],
                                  "page_no long, artists array<struct<id:string,genres:array<string>>>")
    assert {r["artist_id"]: r["genres"] for r in json_scan.artist_genres(pages, "page_no").collect()} == {"x": ["new"], "y": []}


def test_null_keys_are_numbered_last(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (3, 3), (None, 4)], "k long, id long")
    for size in (1_000_000, 1):
        got = {r["id"]: r["idx"] for r in dense_index(df, "k", tiebreak=["id"], rows_per_bucket=size).collect()}
        assert got == {3: 0, 2: 1, 1: 2, 4: 3}
    assert batch_numbers(df, "k", 3, ["id"]).count() == 4


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_column_percentiles_equal_numpy(spark):
    import numpy as np

    from featurelens.operators.quantiles import column_percentiles

    rng = np.random.default_rng(3)
    cols = {"a": rng.normal(size=500), "b": np.r_[np.zeros(400), rng.exponential(1e6, 100)], "c": np.full(500, 7.0), "d": np.full(500, np.nan)}
    rows = [(*(float(cols[c][i]) if i % 9 or c == "c" else None for c in "abcd"),) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    for buckets, few in ((4096, 20_000), (5, 3)):
        got = column_percentiles(df, "abcd", probs, buckets, few)
        for k, c in enumerate("abc"):
            assert got[c] == pytest.approx(list(np.percentile([r[k] for r in rows if r[k] is not None], [p * 100 for p in probs])))
        assert got["d"] == [None] * len(probs)
