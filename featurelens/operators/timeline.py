"""Timeline: the year axis, per-year feature trends, heatmap and comparisons.

Features are unpivoted once and every (year, feature) statistic comes from
one ``groupBy``; medians use the exact bounded-memory quantile operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.functions.columns import quadrant, rnd, trend_arrow
from featurelens.operators.quantiles import exact_percentiles, unpivot


def has_added_axis(df: DataFrame, added: str = "added_year") -> bool:
    """True when some added year is present and some value differs from 0
    (a missing value counts as 'differs', as in the analysed program)."""
    if added not in df.columns:
        return False
    row = df.agg(F.count(added).alias("n"),
                 F.count(F.when(F.col(added).isNull() | (F.col(added) != 0), 1)).alias("nz")).first()
    return row["n"] > 0 and row["nz"] > 0


def with_time_axis(df: DataFrame, added: str = "added_year", release: str = "release_year",
                   out: str = "year", use_added: bool | None = None) -> DataFrame:
    """P22 + F9: added year (zeros replaced by release year) when usable, else
    release year; rows without an axis value are dropped."""
    if use_added is None:
        use_added = has_added_axis(df, added)
    if use_added:
        axis = F.when(F.col(added) == 0, F.col(release)).otherwise(F.col(added))
    else:
        axis = F.col(release)
    return df.withColumn(out, axis.cast("int")).filter(F.col(out).isNotNull())


def yearly_trend(df: DataFrame, features, year: str = "year", min_count: int = 2,
                 min_years: int = 2, clamp=(0.0, 1.0)) -> DataFrame:
    """A12 + F7: mean (3 dp), median, std (n-1, NULL->0), count per (year, feature);
    band = mean -/+ std clamped; only years with >= min_count values and only
    features with >= min_years such years."""
    long = unpivot(df, features, "feature", "value", ids=[year]).filter(F.col("value").isNotNull())
    base = long.groupBy(year, "feature").agg(F.avg("value").alias("mean"),
                                             F.stddev_samp("value").alias("std"),
                                             F.count(F.lit(1)).alias("count"))
    base = base.filter(F.col("count") >= min_count)
    base = base.withColumn("_years", F.count(F.lit(1)).over(Window.partitionBy("feature")))
    base = base.filter(F.col("_years") >= min_years).drop("_years")
    med = exact_percentiles(long, "value", [0.5], group_cols=[year, "feature"]).select(
        year, "feature", F.col("p0").alias("median"))
    m3 = rnd("mean", 3)
    std0 = F.coalesce(F.col("std"), F.lit(0.0))
    lo, hi = clamp
    return base.join(med, [year, "feature"], "left").select(
        year, "feature", m3.alias("mean"), rnd("median", 6).alias("median"),
        rnd(std0, 6).alias("std"), "count",
        rnd(F.greatest(F.lit(lo), m3 - std0), 6).alias("band_lo"),
        rnd(F.least(F.lit(hi), m3 + std0), 6).alias("band_hi"))


def yearly_band(df: DataFrame, column: str, year: str = "year", min_count: int = 2,
                decimals: int = 1) -> DataFrame:
    """Per-year mean and mean -/+ std (NULL std -> 0), unclamped, rounded."""
    g = (df.filter(F.col(column).isNotNull()).groupBy(year)
         .agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.count(F.lit(1)).alias("count"))
         .filter(F.col("count") >= min_count))
    s0 = F.coalesce(F.col("s"), F.lit(0.0))
    return g.select(year, rnd("m", decimals).alias("mean"), rnd(F.col("m") - s0, decimals).alias("lo"),
                    rnd(F.col("m") + s0, decimals).alias("hi"), "count")


def heatmap_long(df: DataFrame, features, year: str = "year", decimals: int = 3) -> DataFrame:
    """Mean per (year, feature) for every year present; all-null -> NULL."""
    long = unpivot(df, features, "feature", "value", ids=[year])
    return long.groupBy(year, "feature").agg(rnd(F.avg("value"), decimals).alias("mean"))


def recent_vs_early(df: DataFrame, features, year: str = "year", window: int = 2,
                    threshold: float = 0.02) -> DataFrame:
    """A16 + P23: mean over the last ``window``+1 years minus mean over the first
    ones (windows may overlap), with the arrow text."""
    bounds = df.agg(F.min(year).alias("ymin"), F.max(year).alias("ymax")).first()
    if bounds["ymin"] is None:
        raise ValueError("no year values")
    ymin, ymax = int(bounds["ymin"]), int(bounds["ymax"])
    long = unpivot(df, features, "feature", "value", ids=[year])
    agg = long.groupBy("feature").agg(
        F.avg(F.when(F.col(year) >= ymax - window, F.col("value"))).alias("recent"),
        F.avg(F.when(F.col(year) <= ymin + window, F.col("value"))).alias("early"))
    diff = F.col("recent") - F.col("early")
    return agg.select("feature", rnd("recent", 6).alias("recent"), rnd("early", 6).alias("early"),
                      rnd(diff, 6).alias("diff"), trend_arrow(diff, threshold).alias("trend"))


def mood_points(df: DataFrame, x: str, y: str, year: str = "year", keep=("row_id",)) -> DataFrame:
    """(x, y) with nulls as 0 and the quadrant label."""
    xv, yv = F.coalesce(F.col(x), F.lit(0.0)), F.coalesce(F.col(y), F.lit(0.0))
    return df.select(*keep, year, rnd(xv, 6).alias("x"), rnd(yv, 6).alias("y"),
                     quadrant(xv, yv).alias("quadrant"))
