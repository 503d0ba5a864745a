"""Opt-in quantile sketches (A2, A12, A26): one pass, mergeable over any grouping.

The exact operators (``quantiles.py``) need a pass or more for each question.
Here one aggregation makes a KLL sketch for every group and column, a table of
a few kilobytes a row that can be stored as a stage; coarser groupings and
later questions merge these rows and never see the data again. Values differ
from the exact ones by a rank error (``RANK_ERROR`` of the group's rows at the
default size), and, the sketch being randomised, from run to run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions.columns import rnd
from featurelens.operators.sizes import broadcast_if_small

#: Size parameter of the sketches, and the share of a group's rows that a rank stays within.
SKETCH_K = 1024
RANK_ERROR = 0.01


def sketch_columns(df: DataFrame, columns, group_cols=(), k: int = SKETCH_K) -> DataFrame:
    """(groups, feature, n, sketch) for every group and column, in one pass.

    Null and NaN are not values; a group without values has n = 0 and a null
    sketch. The groups' columns keep their names, nulls are a group.
    """
    groups = list(group_cols)
    clash = {"feature", "n", "sketch"} & set(groups)
    if clash:
        raise ValueError(f"these names are the result's own: {sorted(clash)}")
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    aggregates = [a for i, v in enumerate(values) for a in (F.count(v).alias(f"_n{i}"), F.kll_sketch_agg_double(v, k).alias(f"_s{i}"))]
    wide = df.groupBy(*groups).agg(*aggregates)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_n{i}").alias("n"), F.when(F.col(f"_n{i}") > 0, F.col(f"_s{i}")).alias("sketch"))
                               for i, c in enumerate(columns)])).alias("_e")
    return wide.select(*groups, each).select(*groups, "_e.*")


def merge_sketches(table: DataFrame, group_cols=()) -> DataFrame:
    """The sketches of coarser groups (a subset of the group columns, or none)."""
    merged = table.groupBy(*group_cols, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def sketch_quantiles(table: DataFrame, probs) -> DataFrame:
    """One row per sketch and probability: the table's other columns, ``p`` and ``value`` (null without values)."""
    probs = [float(p) for p in probs]
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError(f"probabilities must be in [0, 1]: {probs}")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias("value"))
                               for p in probs])).alias("_q")
    others = [c for c in table.columns if c != "sketch"]
    return table.select(*others, each).select(*others, "_q.*")


def rank_errors(df: DataFrame, found: DataFrame, columns, group_cols=()) -> DataFrame:
    """``found`` (of ``sketch_quantiles``) with ``error``: how far p is from the ranks its value has, as a share of n."""
    groups = list(group_cols)
    long = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(groups, list(columns), "feature", "x")
    long = long.where(F.col("x").isNotNull() & ~F.isnan("x"))
    asked = found.where("value IS NOT NULL").select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("feature").alias("_f"), "n", "p", "value")
    same = F.col("feature") == F.col("_f")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    counted = long.join(broadcast_if_small(asked), same).groupBy(*groups, "feature", "n", "p", "value").agg(
        F.count(F.when(F.col("x") < F.col("value"), 1)).alias("below"), F.count(F.when(F.col("x") <= F.col("value"), 1)).alias("upto"))
    return counted.select(*groups, "feature", "n", "p", "value",
                          rnd(F.greatest(F.col("below") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"), F.lit(0.0)), 6).alias("error"))
