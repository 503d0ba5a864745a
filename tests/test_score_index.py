"""The stored index of scores: exact percentiles from one range."""

import glob

import numpy as np
import pytest

from featurelens.operators.outliers import rethreshold
from featurelens.operators.score_index import ScoreIndex, write_index


def stored(spark, path, scores, ranges=8):
    df = spark.createDataFrame([(i, None if s is None else float(s)) for i, s in enumerate(scores)], "id long, s double")
    write_index(df.repartition(5), "id", "s", str(path), ranges)
    return df, ScoreIndex(spark, str(path), "s")


def test_percentiles_are_exact_and_labels_those_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    scores = np.concatenate([rng.normal(size=700), np.full(350, 0.125)])  # a third of the rows have one score
    df, index = stored(spark, tmp_path / "i", scores)
    for pct in (0, 0.5, 5, 12.5, 50, 60, 99.9, 100):
        assert index.threshold(pct) == pytest.approx(np.percentile(scores, pct), abs=1e-15)
        want = {r["id"]: r["outlier_label"] for r in rethreshold(df, "s", pct).collect()}
        assert {r["id"]: r["outlier_label"] for r in index.labelled(pct).collect()} == want
        assert {r["id"] for r in index.outliers(pct).collect()} == {i for i, x in want.items() if x == -1}


def test_a_new_percentile_reads_one_range(spark, tmp_path):
    scores = np.random.default_rng(4).normal(size=800)
    _, index = stored(spark, tmp_path / "i", scores)
    assert len(index.ranges) == 8 and max(r["n"] for r in index.ranges) <= 110
    # the other ranges can't be read any more
    for f in glob.glob(str(tmp_path / "i/rows/score_range=*/*.parquet")):
        if "score_range=0/" not in f:
            with open(f, "wb") as out:
                out.write(b"none")
    limit = index.threshold(5)
    assert limit == pytest.approx(np.percentile(scores, 5), abs=1e-15)
    assert {r["id"] for r in index.outliers(5).collect()} == set(np.flatnonzero(scores < limit).tolist())
    with pytest.raises(Exception):
        index.threshold(50)


def test_missing_scores_and_empty_tables(spark, tmp_path):
    df, index = stored(spark, tmp_path / "a", [None, float("nan"), 3, 1, 2, 2])
    assert index.n == 4 and index.threshold(50) == 2.0
    assert {r["id"]: r["outlier_label"] for r in index.labelled(50).collect()} == {0: 1, 1: 1, 2: 1, 3: -1, 4: 1, 5: 1}
    for name, scores in (("b", []), ("c", [None, None])):
        _, index = stored(spark, tmp_path / name, scores)
        assert index.threshold(5) is None and index.outliers(5).count() == 0
        assert index.labelled(5).where("outlier_label = 1").count() == len(scores)
    with pytest.raises(ValueError):
        index.threshold(101)
    with pytest.raises(ValueError):
        write_index(df.withColumnRenamed("id", "score_range"), "score_range", "s", str(tmp_path / "d"))
