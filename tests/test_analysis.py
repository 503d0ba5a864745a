"""The end-to-end batch analysis on the smallest benchmark tables."""

import os

from featurelens.plans.analysis import analyse_collection
from featurelens.sources.tables import ITEM_FEATURES, order_items

from conftest import SF_SMALL


def test_analyse_collection_end_to_end(spark, tmp_path):
    items = order_items(spark, SF_SMALL)
    res = analyse_collection(items, ITEM_FEATURES, algo="kmeans", n_clusters=4, n_epochs=5,
                             stats_columns={"tempo": "price", "energy": "disc", "dance": "tax",
                                            "valence": "explicit", "duration": "lines"},
                             profile_columns=["qty", "price", "total"], export=True,
                             stage_dir=str(tmp_path / "stages"))
    n_clean = res["items_clean"].count()
    assert n_clean == res["embedding"].count() == res["labels"].count() == res["outlier_scores"].count()
    assert res["labels"].select("cluster").distinct().count() == 4
    assert res["cluster_stats"].count() == 4 and res["optimal_k"].count() == 9
    assert res["stats"].first()["total_tracks"] == n_clean
    assert 0 < res["outlier_share"].first()["n_outliers"] < n_clean
    for key in ("csv", "report", "points"):
        assert res["paths"][key]
    assert os.path.isdir(res["paths"]["items_scored"])


def test_analyse_collection_other_algorithms(spark, tmp_path):
    items = order_items(spark, SF_SMALL)
    for algo in ("dbscan", "hierarchical"):
        res = analyse_collection(items, ITEM_FEATURES, algo=algo, n_clusters=3, eps=0.5, n_epochs=3,
                                 stage_dir=str(tmp_path / algo))
        n = res["items_clean"].count()
        assert res["labels"].count() == n and "optimal_k" not in res
        if algo == "hierarchical":
            assert res["labels"].select("cluster").distinct().count() == 3
