"""Quantile sketches against the exact operator."""

import numpy as np
import pytest

from featurelens.operators import sketches
from featurelens.operators.quantiles import exact_percentiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def data(spark):
    rng = np.random.default_rng(6)
    n = 60_000
    group, sub = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 5, n)), rng.integers(0, 3, n)
    x, y = rng.lognormal(size=n), np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n))
    rows = [(int(a), int(b), float(c), None if i % 50 == 0 else float(d)) for i, (a, b, c, d) in enumerate(zip(group, sub, x, y))]
    return spark.createDataFrame(rows, "g int, h int, x double, y double")


def test_rank_error_of_groups_and_of_merged_groups(spark, tmp_path):
    df = data(spark).cache()
    fine = sketches.sketch_columns(df, ["x", "y"], ["g", "h"])
    fine.write.parquet(str(tmp_path / "s"))  # stored once; the rest never sees the rows
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 30
    for groups in (["g", "h"], ["g"], []):
        table = stored if len(groups) == 2 else sketches.merge_sketches(stored, groups)
        found = sketches.sketch_quantiles(table, PROBS)
        errors = sketches.rank_errors(df, found, ["x", "y"], groups).collect()
        assert len(errors) == table.count() * len(PROBS)
        assert max(r["error"] for r in errors) <= sketches.RANK_ERROR
    exact = exact_percentiles(df, "x", [0.5]).first()
    (row,) = [r for r in sketches.sketch_quantiles(sketches.merge_sketches(stored), [0.5]).collect() if r["feature"] == "x"]
    assert row["n"] == exact["n"] == 60_000 and row["value"] == pytest.approx(exact["p0"], rel=0.05)
    df.unpersist()


def test_groups_without_values_and_bad_arguments(spark):
    df = spark.createDataFrame([(1, None), (1, float("nan")), (2, 5.0), (None, 3.0)], "g int, x double")
    table = sketches.sketch_columns(df, ["x"], ["g"])
    got = {r["g"]: (r["n"], r["value"]) for r in sketches.sketch_quantiles(table, [0.5]).collect()}
    assert got == {1: (0, None), 2: (1, 5.0), None: (1, 3.0)}
    assert {r["g"]: r["error"] for r in sketches.rank_errors(df, sketches.sketch_quantiles(table, [0.5]), ["x"], ["g"]).collect()} == {2: 0.0, None: 0.0}
    (whole,) = sketches.sketch_quantiles(sketches.merge_sketches(table), [1.0]).collect()
    assert (whole["n"], whole["value"]) == (2, 5.0)
    assert sketches.sketch_columns(df.where("false"), ["x"], ["g"]).count() == 0
    with pytest.raises(ValueError):
        sketches.sketch_quantiles(table, [2])
    with pytest.raises(ValueError):
        sketches.sketch_columns(df.withColumnRenamed("g", "n"), ["x"], ["n"])
