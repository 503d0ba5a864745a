"""Query catalogue: each operator bound to the benchmark tables.

Every entry is ``(spark, sf_dir) -> DataFrame`` and reads whole tables (or
data Spark derives from them). ``oracle.py`` holds the SQL twin of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelens.functions.columns import rnd
from featurelens.operators import features as feat
from featurelens.operators import profile, timeline
from featurelens.sources.tables import ITEM_FEATURES, load, order_items

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# --- catalogue parameters -------------------------------------------------
TREND_FEATURES = ["disc", "tax", "explicit"]          # features living in [0, 1]
HEAT_FEATURES = ["qty", "price", "disc", "tax"]
DESCRIBE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HIST_SPECS = [("total", 0.0, 500000.0, 20), ("bal", -1000.0, 10000.0, 22),
              ("qty", 10.0, 40.0, 15)]
PRIORITY_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _clean_items(spark, d):
    """order_items restricted to complete cases of the item features (F2)."""
    return feat.complete_cases(order_items(spark, d), ITEM_FEATURES)


def _timeline_items(spark, d):
    return timeline.with_time_axis(_clean_items(spark, d))


# --- timeline ------------------------------------------------------------

@query("yearly_trend")
def q_yearly_trend(spark, d):
    t = _timeline_items(spark, d)
    return timeline.yearly_trend(t, feat.available_columns(t, TREND_FEATURES))


@query("yearly_tempo_band")
def q_yearly_tempo_band(spark, d):
    return timeline.yearly_band(_timeline_items(spark, d), "total")


@query("heatmap_long")
def q_heatmap_long(spark, d):
    return timeline.heatmap_long(_timeline_items(spark, d), HEAT_FEATURES)


@query("recent_vs_early")
def q_recent_vs_early(spark, d):
    return timeline.recent_vs_early(_timeline_items(spark, d), HEAT_FEATURES)


@query("count_by_year")
def q_count_by_year(spark, d):
    return profile.count_by(order_items(spark, d), "added_year", "year")


@query("count_by_month")
def q_count_by_month(spark, d):
    return profile.count_by(order_items(spark, d), "added_month", "month")


@query("most_active_year")
def q_most_active_year(spark, d):
    return profile.most_active(_timeline_items(spark, d), "year")


# --- profile -------------------------------------------------------------

@query("collection_stats")
def q_collection_stats(spark, d):
    return profile.collection_stats(order_items(spark, d), tempo="price", energy="disc",
                                    dance="tax", valence="explicit", duration="lines")


@query("describe_long")
def q_describe_long(spark, d):
    return profile.describe_long(load(spark, d, "lineitem"), DESCRIBE_COLUMNS)


@query("cluster_profile")
def q_cluster_profile(spark, d):
    return profile.cluster_profile(order_items(spark, d), ["qty", "price", "disc", "tax", "total"])


@query("cluster_table")
def q_cluster_table(spark, d):
    oi = order_items(spark, d).withColumn(
        "cluster", F.when(F.col("cluster") == 4, F.lit(-1)).otherwise(F.col("cluster")))
    return profile.cluster_table(oi, ["qty", "price", "total"])


@query("cluster_table_keys")
def q_cluster_table_keys(spark, d):
    """The cluster table with dominant labels: brand, type over the rows with a brand, size among those of the top brand."""
    part = load(spark, d, "part").withColumns({
        "cluster": (F.col("p_size") % 7 - 1).cast("int"),
        "brand": F.when(F.col("p_partkey") % 5 == 0, F.lit("?")).otherwise(F.col("p_brand")),
        "code": F.when(F.col("p_partkey") % 3 == 0, F.lit("?")).otherwise(F.col("p_size").cast("string"))})
    return profile.cluster_table(part, ["p_retailprice"], name="p_name", artist="p_type", pos="p_partkey", dominant_of=("brand", "p_type", "code"))


@query("correlation_long")
def q_correlation_long(spark, d):
    oi = order_items(spark, d).withColumn("const", F.lit(1.0))
    return profile.correlation_long(oi, ["qty", "price", "disc", "tax", "lines", "total", "bal", "const"])


@query("histogram")
def q_histogram(spark, d):
    return profile.histogram(order_items(spark, d), HIST_SPECS)


@query("histogram_summary")
def q_histogram_summary(spark, d):
    return profile.histogram_summary(order_items(spark, d), HIST_SPECS)


@query("category_counts")
def q_category_counts(spark, d):
    return profile.category_counts(load(spark, d, "orders"), "o_orderpriority", PRIORITY_ORDER)


@query("status_counts")
def q_status_counts(spark, d):
    return profile.binary_counts(load(spark, d, "orders"), "o_orderstatus", ["F", "O"])


@query("dominant_category")
def q_dominant_category(spark, d):
    return profile.dominant(load(spark, d, "part"), "p_type", "p_brand", second="p_size") \
        .select(F.col("p_type"), F.col("top").alias("top_brand"), F.col("top_n").alias("top_count"),
                F.col("top_second").alias("top_size"))


@query("radar")
def q_radar(spark, d):
    oi = order_items(spark, d)
    cols = ["qty", "price", "disc", "tax", "bal"]
    b = oi.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    scaled = oi.select(*[((F.col(c) - F.lit(b[f"lo_{c}"])) / F.lit(b[f"hi_{c}"] - b[f"lo_{c}"])).alias(c)
                         for c in cols])
    return profile.radar(scaled, feat.available_columns(scaled, cols))


# --- features ------------------------------------------------------------

@query("complete_case")
def q_complete_case(spark, d):
    oi = order_items(spark, d)
    gate = feat.available_columns(oi, ["qty", "price", "disc"])
    if len(gate) < 3:
        return feat.complete_cases(oi, ["lines"]).select("row_id")
    return feat.complete_cases(oi, ITEM_FEATURES).select("row_id", *[rnd(c, 6).alias(c) for c in ITEM_FEATURES])


@query("median_impute")
def q_median_impute(spark, d):
    oi = order_items(spark, d)
    cols = ["qty", "price", "disc", "tax", "release_year"]
    filled = feat.median_fill(oi, cols)
    return filled.select("row_id", *[rnd(c, 6).alias(c) for c in cols])


@query("standardise")
def q_standardise(spark, d):
    _, matrix, _, names = feat.engineer_features(order_items(spark, d), ITEM_FEATURES,
                                                 gate=["qty", "price", "disc"])
    return matrix.select("row_id", *[rnd(c, 6).alias(c) for c in names])


@query("scaler")
def q_scaler(spark, d):
    _, _, scaler, _ = feat.engineer_features(order_items(spark, d), ITEM_FEATURES,
                                             gate=["qty", "price", "disc"])
    return scaler.select("feature", rnd("mean", 6).alias("mean"), rnd("std_pop", 6).alias("std_pop"))


@query("metadata_matrix")
def q_metadata_matrix(spark, d):
    _, matrix, _, names = feat.metadata_matrix(order_items(spark, d), ["release_year", "lines", "explicit"],
                                               required="lines")
    return matrix.select("row_id", *[rnd(c, 6).alias(c) for c in names])


# bindings kept in sibling modules register themselves on import
from featurelens.plans import ingest_queries  # noqa: E402,F401
from featurelens.plans import explore_queries  # noqa: E402,F401
from featurelens.plans import similarity_queries  # noqa: E402,F401
from featurelens.plans import model_queries  # noqa: E402,F401
from featurelens.plans import sink_queries  # noqa: E402,F401
