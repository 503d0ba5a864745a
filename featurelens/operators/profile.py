"""Collection profile: summary statistics, distributions, correlations, groups.

All aggregates are single ``groupBy``/``agg`` plans (partial aggregation
before the shuffle); several features are handled in one pass by
unpivoting once instead of one job per feature.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions.columns import rnd
from featurelens.operators.quantiles import column_percentiles, unpivot


def collection_stats(df: DataFrame, artist="artist", album="album", year="release_year",
                     tempo="tempo", energy="energy", dance="danceability", valence="valence",
                     duration="duration_min") -> DataFrame:
    """A1 + A22: one summary row; absent or all-NULL numeric columns give NULL
    (the analysed program's "N/A")."""
    def col(c):
        return F.col(c) if c in df.columns else F.lit(None).cast("double")

    tempo, energy, dance, valence, year = col(tempo), col(energy), col(dance), col(valence), col(year)
    total_duration = (rnd(F.coalesce(F.sum(duration), F.lit(0.0)), 1) if duration in df.columns
                      else F.lit(None).cast("double"))
    return df.agg(
        F.count(F.lit(1)).alias("total_tracks"),
        F.count_distinct(F.col(artist)).alias("unique_artists"),
        F.count_distinct(F.col(album)).alias("unique_albums"),
        F.min(year).alias("year_min"),
        F.max(year).alias("year_max"),
        rnd(F.avg(tempo), 1).alias("avg_bpm"),
        rnd(F.avg(energy), 3).alias("avg_energy"),
        rnd(F.avg(dance), 3).alias("avg_danceability"),
        rnd(F.avg(valence), 3).alias("avg_valence"),
        total_duration.alias("total_duration_min"),
    )


def describe_long(df: DataFrame, columns, decimals: int = 3) -> DataFrame:
    """A2: count, mean, std (n-1), min, 25/50/75 % (exact), max per column."""
    long = unpivot(df, columns, "feature", "value")
    base = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    found = column_percentiles(df, columns, [0.25, 0.5, 0.75])
    q = df.sparkSession.createDataFrame([(c, *v) for c, v in found.items()], "feature string, p0 double, p1 double, p2 double")
    out = base.join(F.broadcast(q), "feature", "left")  # a row a column
    return out.select("feature", "count",
                      *[rnd(F.col(a), decimals).alias(b) for a, b in
                        [("mean", "mean"), ("std", "std"), ("min", "min"), ("p0", "p25"),
                         ("p1", "p50"), ("p2", "p75"), ("max", "max")]])


def cluster_profile(df: DataFrame, features, cluster="cluster", decimals: int = 3) -> DataFrame:
    """A4 + A6: mean and std (n-1) per feature and size per cluster (noise included)."""
    aggs = []
    for f in features:
        aggs += [rnd(F.avg(f), decimals).alias(f"{f}_mean"), rnd(F.stddev_samp(f), decimals).alias(f"{f}_std")]
    return df.groupBy(cluster).agg(*aggs, F.count(F.lit(1)).alias("count"))


def cluster_table(df: DataFrame, features, cluster="cluster", name="name", artist="artist",
                  pos="pos", decimals: int = 3, separator: str = " — ", dominant_of: tuple[str, str, str] | None = None) -> DataFrame:
    """A5 + F6 + W6: clusters without noise; size, means and first member as label.

    ``dominant_of`` = (category, label, code) adds the columns of ``dominant_labels``,
    unless no row has a category.
    """
    label = F.concat_ws(separator, F.col(name), F.col(artist))
    kept = df.filter(F.col(cluster) != -1)
    table = (kept.groupBy(cluster)
             .agg(F.count(F.lit(1)).alias("size"),
                  *[rnd(F.avg(f), decimals).alias(f"{f}_mean") for f in features],
                  F.min_by(label, F.col(pos)).alias("representative")))
    if dominant_of is None or df.filter(F.col(dominant_of[0]).cast("string") != "?").isEmpty():
        return table
    return table.join(dominant_labels(kept, cluster, *dominant_of), cluster)


def dominant_labels(df: DataFrame, group: str, category: str, label: str, code: str, sentinel: str = "?") -> DataFrame:
    """(group, dominant_category, dominant_code).

    ``dominant_category`` is the most frequent category, a space and the most
    frequent ``label`` over all rows of the group that have a category;
    ``dominant_code`` is the most frequent ``code`` among the rows with the top
    category, codes equal to the sentinel left out. The sentinel stands for what a
    group lacks. Nulls count as the sentinel in category and code, and are
    left out of labels; ties go to the smallest value.

    Counts of (group, category, label, code) are combined once; everything else is
    an aggregation of that small table.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(sentinel))
    cells = df.select(F.col(group).alias("_g"), value(category).alias("_c"), F.col(label).cast("string").alias("_l"), value(code).alias("_k")) \
        .groupBy("_g", "_c", "_l", "_k").agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    valid = cells.where(F.col("_c") != sentinel)

    def mode(table: DataFrame, column: str, out: str) -> DataFrame:
        counts = table.groupBy("_g", column).agg(F.sum("_n").alias("_n"))
        return counts.groupBy("_g").agg(F.min_by(F.col(column), F.struct(-F.col("_n"), F.col(column))).alias(out))

    top = mode(valid, "_c", "_top")
    labels = mode(valid.where("_l IS NOT NULL"), "_l", "_label")
    codes = mode(valid.join(top, "_g").where((F.col("_c") == F.col("_top")) & (F.col("_k") != sentinel)), "_k", "_code")
    found = cells.select("_g").distinct().join(top, "_g", "left").join(labels, "_g", "left").join(codes, "_g", "left")
    both = F.concat_ws(" ", "_top", F.coalesce("_label", F.lit(sentinel)))
    return found.select(F.col("_g").alias(group), F.when(F.col("_top").isNull(), F.lit(sentinel)).otherwise(both).alias("dominant_category"),
                        F.coalesce("_code", F.lit(sentinel)).alias("dominant_code"))


def correlation_long(df: DataFrame, columns, decimals: int = 2) -> DataFrame:
    """Pairwise-complete Pearson matrix as (x, y, value); constants give NULL.

    One aggregate computes every pair; the d*d long rows are exploded from it.
    The covariance leaves out incomplete pairs by itself; a deviation is taken
    over complete pairs only where the other column has NULLs.
    """
    cols = list(columns)
    if not cols:
        return df.select(F.lit("").alias("x"), F.lit("").alias("y"), F.lit(0.0).alias("value")).limit(0)
    some_null = df.agg(*[F.max(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    has_null = {c: bool(some_null[f"_{i}"]) for i, c in enumerate(cols)}

    def deviation(c: str, other: str):
        v = F.col(c).cast("double")
        return F.stddev_pop(F.when(F.col(other).isNotNull(), v) if has_null[other] and other != c else v)

    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            r = F.try_divide(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")), deviation(a, b) * deviation(b, a))
            aggs.append(r.alias(f"{a}\u0001{b}"))
    row_df = df.agg(*aggs)
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            key = f"{a}\u0001{b}" if i <= j else f"{b}\u0001{a}"
            cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{key}`").alias("v")))
    return row_df.select(F.explode(F.array(*cells)).alias("c")) \
        .select("c.x", "c.y", rnd(F.col("c.v"), decimals).alias("value"))


def _hist_input(df: DataFrame, specs):
    spark = df.sparkSession
    spec_df = spark.createDataFrame([(c, float(lo), float(hi), int(n)) for c, lo, hi, n in specs],
                                    "feature string, lo double, hi double, bins int")
    long = unpivot(df, [s[0] for s in specs], "feature", "value").filter(F.col("value").isNotNull())
    # spec table has one row per histogram: a parameter-sized broadcast
    j = long.join(F.broadcast(spec_df), "feature")
    clipped = F.least(F.greatest(F.col("value"), F.col("lo")), F.col("hi"))
    return spec_df, j.withColumn("clipped", clipped)


def histogram(df: DataFrame, specs) -> DataFrame:
    """Fixed-range histograms with clipping; last bin closed; empty bins kept.

    ``specs`` = [(column, lo, hi, bins)]. Output (feature, bin, bin_lo, bin_hi, count).
    """
    spec_df, j = _hist_input(df, specs)
    b = F.least(F.floor((F.col("clipped") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")) + 1,
                F.col("bins"))
    counts = j.withColumn("bin", b.cast("int")).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = spec_df.select("feature", "lo", "hi", "bins", F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    return (F.broadcast(grid).join(counts, ["feature", "bin"], "left")
            .select("feature", "bin",
                    rnd((F.col("bin") - 1) * step + F.col("lo"), 6).alias("bin_lo"),
                    rnd(F.col("bin") * step + F.col("lo"), 6).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def histogram_summary(df: DataFrame, specs) -> DataFrame:
    """Mean of the clipped values and the tallest bin per histogram."""
    _, j = _hist_input(df, specs)
    mean = j.groupBy("feature").agg(rnd(F.avg("clipped"), 6).alias("mean_clipped"))
    peak = histogram(df, specs).groupBy("feature").agg(F.max("count").alias("peak"))
    return mean.join(peak, "feature")


def category_counts(df: DataFrame, column: str, order) -> DataFrame:
    """A10: counts in a fixed category order; absent categories omitted."""
    spark = df.sparkSession
    order_df = spark.createDataFrame([(c, i) for i, c in enumerate(order)], f"{column} string, ord int")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(order_df), column).select(F.col(column).alias("category"), "ord", "n")


def binary_counts(df: DataFrame, column: str, labels) -> DataFrame:
    """A10 (two-way): count of each label, 0 when absent."""
    spark = df.sparkSession
    lab = spark.createDataFrame([(c, i) for i, c in enumerate(labels)], "category string, ord int")
    counts = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(lab).join(counts, "category", "left") \
        .select("category", "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_by(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    """Rows per value (nulls dropped), ordered by the value."""
    a = alias or column
    return (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(a))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(a))


def most_active(df: DataFrame, column: str, alias: str = "year") -> DataFrame:
    """The value with the most rows (smallest on ties) and its count."""
    c = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(alias)).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min_by(F.col(alias), F.struct(-F.col("n"), F.col(alias))).alias(alias),
                 F.max("n").alias("n"))


def dominant(df: DataFrame, group: str, category: str, second: str | None = None,
             sentinel: str = "?") -> DataFrame:
    """A18 + F8: most frequent category per group (smallest on ties, sentinel
    excluded, sentinel when none), and the most frequent ``second`` value among
    the group's rows carrying that category.

    Two-level aggregation: (group, category) counts are combined map-side, so
    a hot group costs one partial aggregate, never a collected list.
    """
    valid = df.filter(F.col(category).isNotNull() & (F.col(category).cast("string") != sentinel))
    counts = valid.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(group).agg(
        F.min_by(F.col(category), F.struct(-F.col("n"), F.col(category))).alias("top"),
        F.max("n").alias("top_n"))
    groups = df.select(group).distinct()
    out = groups.join(top, group, "left")
    if second is not None:
        sec = (df.join(top, [group]).filter(F.col(category) == F.col("top"))
               .filter(F.col(second).isNotNull())
               .groupBy(group, second).agg(F.count(F.lit(1)).alias("n2"))
               .groupBy(group).agg(F.min_by(F.col(second), F.struct(-F.col("n2"), F.col(second))).alias("top_second")))
        out = out.join(sec, group, "left")
    return out.withColumn("top", F.coalesce(F.col("top").cast("string"), F.lit(sentinel)))


def coverage(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value in ``column`` over all rows."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(column).alias("with_features")) \
        .withColumn("coverage", rnd(F.try_divide(F.col("with_features"), F.col("total")), 6))


def radar(df: DataFrame, features) -> DataFrame:
    """A21 + P18: mean per feature laid on a closed polygon (needs >= 3 features)."""
    feats = list(features)
    n = len(feats)
    if n < 3:
        raise ValueError("radar needs at least three usable features")
    means = df.agg(*[F.avg(f).alias(f) for f in feats])
    pts = [F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f).alias("mean"),
                    F.lit(2 * math.pi * i / n - math.pi / 2).alias("angle"))
           for i, f in enumerate(feats)]
    pts.append(F.struct(F.lit(n).alias("i"), F.lit(feats[0]).alias("feature"), F.col(feats[0]).alias("mean"),
                        F.lit(-math.pi / 2).alias("angle")))
    p = means.select(F.explode(F.array(*pts)).alias("p")).select("p.*")
    return p.select("i", "feature", rnd("mean", 6).alias("mean"),
                    rnd(F.col("mean") * F.cos("angle"), 6).alias("x"),
                    rnd(F.col("mean") * F.sin("angle"), 6).alias("y"))


def first_seen_rank(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Distinct keys numbered 0.. by the position of their first row."""
    firsts = df.groupBy(key).agg(F.min(pos).alias("_first"))
    from featurelens.operators.positions import dense_index
    return dense_index(firsts, "_first", out="rank").drop("_first")

