"""Hand-worked edge cases: histogram edges (A8), time axis with zero / null
years (P22), strict re-thresholding (M12), NULL ordering in top-N (T2),
NaN-passing range filters (F4), filter-domain fallbacks (F5), correlation of
a constant (A7), yearly trend filters (F7)."""

import math

import numpy as np

from featurelens.operators import explore, outliers, profile, timeline


def test_histogram_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(v,) for v in [-5.0, 0.0, 0.5, 1.0, 2.0, 10.0, None]], "v double")
    h = {r.bin: r["count"] for r in profile.histogram(df, [("v", 0.0, 2.0, 4)]).collect()}
    # -5 clipped to 0 -> bin 1; 0.5 -> bin 2; 1.0 -> bin 3; 2.0 and 10 (clipped) -> last bin; NULL skipped
    assert h == {1: 2, 2: 1, 3: 1, 4: 2}
    want, _ = np.histogram(np.clip([-5.0, 0.0, 0.5, 1.0, 2.0, 10.0], 0, 2), bins=4, range=(0, 2))
    assert [h[i] for i in range(1, 5)] == want.tolist()
    s = profile.histogram_summary(df, [("v", 0.0, 2.0, 4)]).first()
    assert s.peak == 2 and abs(s.mean_clipped - np.mean([0, 0, 0.5, 1, 2, 2])) < 1e-6


def test_time_axis_zero_and_null_years(spark):
    df = spark.createDataFrame([(1, 2020, 1999), (2, 0, 1998), (3, None, 1997), (4, 0, None)],
                               "id int, added_year int, release_year int")
    got = {r.id: r.year for r in timeline.with_time_axis(df).collect()}
    # zero -> release year; NULL added year is not replaced (row dropped); no axis -> dropped
    assert got == {1: 2020, 2: 1998}
    none_added = spark.createDataFrame([(1, None, 1999), (2, None, None)], "id int, added_year int, release_year int")
    assert {r.id: r.year for r in timeline.with_time_axis(none_added).collect()} == {1: 1999}


def test_rethreshold_is_strict(spark):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10])],
                               "id int, anomaly_score double")
    # 20th percentile of 1..10 with linear interpolation = 2.8 -> scores 1 and 2 flagged
    got = {r.id: r.outlier_label for r in outliers.rethreshold(df, pct=20.0).collect()}
    assert [k for k, v in got.items() if v == -1] == [0, 1]
    tie = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "id int, anomaly_score double")
    assert all(r.outlier_label == 1 for r in outliers.rethreshold(tie, pct=50.0).collect())   # not below


def test_top_n_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(0, None), (1, 5.0), (2, 1.0), (3, 5.0), (4, None)], "pos long, v double")
    desc = [r.pos for r in explore.top_n(df, "v", 4, True).collect()]
    asc = [r.pos for r in explore.top_n(df, "v", 4, False).collect()]
    assert desc == [1, 3, 2, 0] and asc == [2, 1, 3, 0]
    assert [r.pos for r in explore.top_n(df, "missing", 2).collect()] == [0, 1]


def test_visibility_nan_passes_null_compared_as_default(spark):
    df = spark.createDataFrame([(0, float("nan"), "a"), (1, None, "a"), (2, 0.5, "b"), (3, 0.5, "a")],
                               "id int, v double, c string")
    vis = {r.id: r.visible for r in explore.visibility(df, {"v": (0.2, 1.0)}, {"c": ["a"]}).collect()}
    assert vis == {0: True, 1: False, 2: False, 3: True}


def test_filter_domain_fallbacks(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "v double, y int")
    got = {r.feature: (r.lo, r.hi) for r in explore.filter_domain(df, ["v"], year_col="y").collect()}
    assert got == {"v": (0.0, 1.0), "y": (1900.0, 2025.0)}


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.1, 7.0), (3.0, None, 7.0)], "a double, b double, k double")
    got = {(r.x, r.y): r.value for r in profile.correlation_long(df, ["a", "b", "k"]).collect()}
    assert got[("a", "k")] is None and got[("k", "k")] is None and got[("a", "a")] == 1.0
    assert got[("a", "b")] == 1.0 and got[("a", "b")] == got[("b", "a")]


def test_yearly_trend_group_filters(spark):
    rows = [(2000, 0.2), (2000, 0.4), (2001, 0.9), (2002, 0.1), (2002, 0.3), (2002, 0.5)]
    df = spark.createDataFrame(rows, "year int, f double")
    out = {r.year: r for r in timeline.yearly_trend(df, ["f"]).collect()}
    assert set(out) == {2000, 2002}                       # 2001 has one value
    assert out[2002]["count"] == 3 and abs(out[2002].median - 0.3) < 1e-12
    assert abs(out[2000].band_lo - max(0.0, round(0.3, 3) - math.sqrt(0.02))) < 1e-6
    single = spark.createDataFrame([(2000, 0.2), (2000, 0.4)], "year int, f double")
    assert timeline.yearly_trend(single, ["f"]).count() == 0   # fewer than two usable years


def test_models_of_empty_tables(spark):
    from featurelens.operators import explore, features
    from featurelens.operators.forest import isolation_forest

    none = spark.createDataFrame([], "id long, a double, b double")
    holes = spark.createDataFrame([(1, None, 2.0)], "id long, a double, b double")
    full = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(8)], "id long, a double, b double")
    want = isolation_forest(full, "id", ["a", "b"], n_trees=3).schema
    for df in (none, holes):
        got = isolation_forest(df, "id", ["a", "b"], n_trees=3)
        assert got.count() == 0 and [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want]
    coloured = explore.continuous_index(none, "a")
    assert coloured.count() == 0 and coloured.columns == ["id", "a", "b", "num_idx"]
    coords, ratio, loadings = features.pca(none, ["a", "b"], keep=("id",))
    assert coords.count() == 0 and coords.columns == ["id", "pc1", "pc2"] and ratio == [] and loadings.shape == (2, 2)
