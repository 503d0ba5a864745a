"""Catalogue bindings for the explorer: filters, colours, projections, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.functions.columns import rnd
from featurelens.operators import explore, sketches, timeline
from featurelens.plans.catalogue import _timeline_items, query
from featurelens.sources.tables import load, order_items

RANGES = {"l_quantity": (5.0, 40.0), "l_discount": (0.02, 0.08), "l_tax": (0.0, 0.06), "ship_year": (1995, 1997)}
FLAGS = ["A", "N"]
DOMAIN_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SEARCH = "  Blue B.lt "
TOP_N = 20
SKETCH_PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query("range_filter")
def q_range_filter(spark, d):
    li = load(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate")) \
        .withColumn("is_out", (F.col("l_linestatus") == "F").cast("int"))
    v = explore.visibility(li, RANGES, {"l_returnflag": FLAGS})
    v = explore.visibility(v, RANGES, {"l_returnflag": FLAGS}, outlier="is_out", only_outliers=True,
                           out="visible_outliers")
    return v.select("l_orderkey", "l_linenumber", F.col("visible").cast("int").alias("visible"),
                    F.col("visible_outliers").cast("int").alias("visible_outliers"))


@query("filter_domain")
def q_filter_domain(spark, d):
    li = load(spark, d, "lineitem")
    return explore.filter_domain(li, DOMAIN_COLUMNS, year_col="ship_year", year_expr=F.year("l_shipdate"))


@query("palette_index")
def q_palette_index(spark, d):
    oi = order_items(spark, d)
    p = explore.continuous_index(oi, "price")
    p = explore.category_index(p, "cluster", out="cluster_idx", color_out="cluster_color")
    p = explore.category_index(p, "artist", order_by="pos", out="artist_idx", color_out="artist_color")
    return p.select("row_id", "num_idx", "cluster_idx", "cluster_color", "artist_idx", "artist_color",
                    explore.flag_colour("explicit").alias("flag_color"))


@query("point_projection")
def q_point_projection(spark, d):
    oi = explore.category_index(order_items(spark, d), "cluster", out="cluster_idx", color_out="color")
    pres = explore.presentation(oi, ["qty", "price"], keep=["row_id", "name", "artist", "cluster", "color",
                                                            "disc", "tax", F.col("price").alias("tempo_raw")])
    pts = explore.axis_projection(pres, "qty", "price", keep=["row_id", "name", "artist", "cluster", "color",
                                                              "disc", "tax", "tempo_raw"])
    return pts.select("row_id", "x", "y", "name", "artist", "cluster",
                      rnd(F.coalesce("disc", F.lit(0.0)), 2).alias("energy"),
                      rnd(F.coalesce("tempo_raw", F.lit(0.0)), 1).alias("tempo"),
                      rnd(F.coalesce("tax", F.lit(0.0)), 2).alias("valence"), "color")


def _listing(df):
    return df.select("row_id", "name", "artist", rnd("price", 3).alias("price"), "total")


@query("top_n")
def q_top_n(spark, d):
    return _listing(explore.top_n(order_items(spark, d), "price", TOP_N, descending=True))


@query("bottom_n")
def q_bottom_n(spark, d):
    return _listing(explore.top_n(order_items(spark, d), "price", TOP_N, descending=False))


@query("name_search")
def q_name_search(spark, d):
    part = load(spark, d, "part").withColumn("pos", F.col("p_partkey"))
    return explore.first_match(part, "p_name", SEARCH).select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query("mood_quadrant")
def q_mood_quadrant(spark, d):
    tl = _timeline_items(spark, d)
    b = tl.agg(F.min("disc").alias("ld"), F.max("disc").alias("hd"), F.min("qty").alias("lq"),
               F.max("qty").alias("hq")).first()
    scaled = tl.select("row_id", "year",
                       ((F.col("disc") - F.lit(b["ld"])) / F.lit(b["hd"] - b["ld"])).alias("sx"),
                       ((F.col("qty") - F.lit(b["lq"])) / F.lit(b["hq"] - b["lq"])).alias("sy"))
    return timeline.mood_points(scaled, "sx", "sy")


@query("quantile_sketch")
def q_quantile_sketch(spark, d):
    """Sketches by flag and status, merged by flag; are their quantiles' ranks within the bound?"""
    li = load(spark, d, "lineitem")
    fine = sketches.sketch_columns(li, DOMAIN_COLUMNS, ["l_returnflag", "l_linestatus"])
    found = sketches.sketch_quantiles(sketches.merge_sketches(fine, ["l_returnflag"]), SKETCH_PROBS)
    errors = sketches.rank_errors(li, found, DOMAIN_COLUMNS, ["l_returnflag"])
    return errors.select("l_returnflag", "feature", "n", "p", (F.col("error") <= sketches.RANK_ERROR).alias("within_bound"))
