"""Exact quantiles (forced through several narrowing passes), dense index,
batches, de-duplication and the link-or-position join."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from featurelens.operators.positions import batch_numbers, dedupe_last, dense_index, resolve_by_link_or_position
from featurelens.operators.quantiles import exact_percentiles


def test_grouped_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 4, 3000)
    v = np.round(rng.normal(size=3000) * 10, 1)             # many ties
    v[:5] = np.nan
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    res = exact_percentiles(df, "v", probs, group_cols=["g"], buckets=7, max_collect=10).toPandas()
    for _, row in res.iterrows():
        vals = pdf[(pdf.g == row.g) & pdf.v.notna()].v.to_numpy()
        for i, p in enumerate(probs):
            assert abs(row[f"p{i}"] - np.percentile(vals, 100 * p)) < 1e-9


def test_global_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.exponential(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    res = exact_percentiles(df, "v", [0.05, 0.5], buckets=5, max_collect=3).first()
    assert abs(res["p0"] - np.percentile(v, 5)) < 1e-12 and abs(res["p1"] - np.median(v)) < 1e-12


def test_dense_index_small_buckets_matches_row_number(spark):
    ids = np.random.default_rng(3).permutation(np.arange(0, 5000, 7))
    df = spark.createDataFrame(pd.DataFrame({"k": ids}))
    out = dense_index(df, "k", rows_per_bucket=37).toPandas().sort_values("k")
    assert out["idx"].tolist() == list(range(len(ids)))


def test_batches(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(25)], "k long")
    out = batch_numbers(df, "k", 10).orderBy("k").collect()
    assert [(r.batch_no, r.pos_in_batch) for r in out][:12] == [(0, i) for i in range(10)] + [(1, 0), (1, 1)]
    assert out[-1].batch_no == 2 and out[-1].pos_in_batch == 4


def test_dedupe_last_with_priority(spark):
    df = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 1, "b"), (1, 0, 2, "c"), (2, 3, 9, "d")],
                               "id int, pri int, pos int, v string")
    got = {r.id: r.v for r in dedupe_last(df, "id", "pos", priority="pri").collect()}
    assert got == {1: "c", 2: "d"}


def test_link_or_position(spark):
    req = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (0, 2, "z"), (1, 0, "w")],
                                "batch_no long, pos_in_batch int, id string")
    # y is linked explicitly (response position 0); x has no link -> response at its position 0;
    # z: no link and no response at position 2 -> none; two links to w: the later wins
    resp = spark.createDataFrame([(0, 0, "y", 10.0), (0, 1, None, 20.0), (1, 0, "w", 1.0), (1, 1, "w", 2.0)],
                                 "batch_no long, resp_pos int, link_id string, payload double")
    out = {r.id: (r.payload, r.matched_by) for r in resolve_by_link_or_position(req, resp).collect()}
    assert out == {"x": (10.0, "position"), "y": (10.0, "link"), "z": (None, "none"), "w": (2.0, "link")}
    assert F is not None
