"""Outlier scoring, re-thresholding and the most-anomalous list.

``rethreshold`` reads stored scores only: one exact percentile (bounded
memory, see ``quantiles.py``) and a projection. The isolation forest lives
in ``forest.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.operators.quantiles import exact_percentile_scalars


def score_threshold(df: DataFrame, score: str, pct: float) -> float | None:
    """The ``pct``-th percentile of the scores (linear interpolation)."""
    return exact_percentile_scalars(df, score, [pct / 100.0])[0]


def rethreshold(df: DataFrame, score: str = "anomaly_score", pct: float = 5.0,
                out: str = "outlier_label") -> DataFrame:
    """-1 where the score is strictly below the percentile, else 1."""
    thr = score_threshold(df, score, pct)
    if thr is None:
        return df.withColumn(out, F.lit(1))
    return df.withColumn(out, F.when(F.col(score) < F.lit(float(thr)), F.lit(-1)).otherwise(F.lit(1)))


def most_anomalous(df: DataFrame, score: str = "anomaly_score", label: str = "outlier_label",
                   columns=(), n: int = 30, pos: str = "pos") -> DataFrame:
    """Flagged rows, most anomalous (lowest score) first, at most ``n``."""
    flagged = df.filter(F.col(label) == -1)
    return flagged.orderBy(F.col(score).asc(), F.col(pos).asc()).limit(n).select(*columns)


def outlier_share(df: DataFrame, label: str = "outlier_label", decimals: int = 1) -> DataFrame:
    """Number of flagged rows and their percentage of all rows."""
    from featurelens.functions.columns import rnd

    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(label) == -1, 1)).alias("n_outliers")) \
        .withColumn("pct_outliers", rnd(F.try_divide(F.col("n_outliers") * 100.0, F.col("n")), decimals))
