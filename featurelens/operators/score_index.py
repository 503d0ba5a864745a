"""Stored order statistics of scores (M12): a new percentile reads one range.

Scores are written once, in ranges of about equal counts (a partition folder
each, cut at approximate percentiles), beside a small table of the ranges'
counts, minima and maxima. A percentile's rank then names its range by the
counts alone, and the exact value is read from that range; the rows below a
threshold are those of the ranges before it and a part of one. Scores that
are null or NaN have a range of their own and are never below a threshold.

A range holds whole values: where one score is shared by a third of all rows,
its range is larger, but its minimum is its maximum and nothing is read.
Within a range rows are spread over files by a hash of the id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelens.operators.quantiles import values_at

RANGES = 64
#: Rows a file, about.
FILE_ROWS = 5_000_000
NO_SCORE = -1


def _range_of(score: Column, cuts: list[float]) -> Column:
    """Number of cuts below the score, by bisection."""

    def find(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(score <= F.lit(cuts[mid]), find(lo, mid)).otherwise(find(mid + 1, hi))

    return F.when(score.isNull() | F.isnan(score), F.lit(NO_SCORE)).otherwise(find(0, len(cuts)))


def write_index(df: DataFrame, id_col: str, score: str, path: str, ranges: int = RANGES) -> None:
    """Write the rows of ``df`` with a column ``score_range``, and the ranges' counts, below ``path``.

    ``df`` is evaluated once for the cuts and once for the rows; at most
    ``ranges`` cuts reach the driver. An empty table gives an empty index.
    """
    if "score_range" in df.columns or ranges < 1:
        raise ValueError("score_range is the index's own column, and ranges must be positive")
    value = F.col(score).cast("double")
    known = F.when(~F.isnan(value), value)
    shares = [i / ranges for i in range(1, ranges)]
    st = df.agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx(known, shares or [0.5], 100 * ranges).alias("cuts")).first()
    cuts = sorted(set(st["cuts"] or [])) if shares else []
    files = max(1, math.ceil(st["rows"] / ranges / FILE_ROWS))
    spread = F.pmod(F.xxhash64(id_col), F.lit(files))
    ranged = df.withColumn("score_range", _range_of(value, cuts))
    writer = ranged.repartition("score_range", spread).write
    # without rows there would be no file to take the schema from
    (writer.partitionBy("score_range") if st["rows"] else writer).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    counts = rows.groupBy("score_range").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    counts.coalesce(1).write.parquet(f"{path}/counts")  # a row a range


class ScoreIndex:
    """An index written by ``write_index``."""

    def __init__(self, spark: SparkSession, path: str, score: str):
        self.rows = spark.read.parquet(f"{path}/rows")
        self.score = score
        found = spark.read.parquet(f"{path}/counts").collect()  # a row a range
        self.ranges = sorted((r for r in found if r["score_range"] != NO_SCORE), key=lambda r: r["score_range"])
        self.n = sum(r["n"] for r in self.ranges)

    def value(self, rank: int) -> float:
        """The score of a rank (from 0)."""
        below = 0
        for r in self.ranges:
            if rank < below + r["n"]:
                inside = self.rows.where(F.col("score_range") == r["score_range"]).select(F.col(self.score).cast("double").alias("_v"))
                return float(values_at(inside, [rank], r["lo"], r["hi"], below, r["n"])[rank])
            below += r["n"]
        raise IndexError(rank)

    def threshold(self, pct: float) -> float | None:
        """The ``pct``-th percentile of the scores (linear interpolation); None without scores."""
        if not 0 <= pct <= 100:
            raise ValueError(f"not a percentage: {pct}")
        if not self.n:
            return None
        rank = pct / 100.0 * (self.n - 1)
        low, high = self.value(math.floor(rank)), self.value(math.ceil(rank))
        return low + (high - low) * (rank - math.floor(rank))

    def outliers(self, pct: float) -> DataFrame:
        """The rows strictly below the percentile; other ranges aren't read."""
        limit = self.threshold(pct)
        if limit is None:
            return self.rows.drop("score_range").limit(0)
        last = max((r["score_range"] for r in self.ranges if r["lo"] < limit), default=NO_SCORE)
        found = self.rows.where((F.col("score_range") > NO_SCORE) & (F.col("score_range") <= last))
        return found.where(F.col(self.score) < F.lit(limit)).drop("score_range")

    def labelled(self, pct: float, out: str = "outlier_label") -> DataFrame:
        """All rows, -1 where the score is strictly below the percentile, else 1."""
        limit = self.threshold(pct)
        flag = F.lit(1) if limit is None else F.when(F.col(self.score) < F.lit(limit), F.lit(-1)).otherwise(F.lit(1))
        return self.rows.drop("score_range").withColumn(out, flag)
