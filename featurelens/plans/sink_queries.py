"""Catalogue bindings for landed-JSON scans, stage tables and exports.

Each query writes with the DataFrame writer below the shared folder and
returns what it reads back, so the round trip itself is what is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.functions.columns import rnd
from featurelens.operators import profile, similarity
from featurelens.plans.catalogue import QUERIES, query
from featurelens.session import shared_dir
from featurelens.sources import json_scan, sinks
from featurelens.sources.tables import ITEM_FEATURES, load, order_items

REPORT_TITLE = "Collection Analysis Report"
REPORT_PROFILE = ITEM_FEATURES
REPORT_COLUMNS = [f"{c}_{s}" for c in REPORT_PROFILE for s in ("mean", "std")]


@query("header_read")
def q_header_read(spark, d):
    cust = load(spark, d, "customer")
    nation = load(spark, d, "nation")
    headers = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey).select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"),
        F.struct(F.col("n_name").alias("display_name")).alias("owner"),
        F.array(F.struct(F.concat(F.lit("https://img.example.org/"), F.col("c_custkey").cast("string")).alias("url")))
        .alias("images"),
        F.struct(F.floor("c_acctbal").cast("long").alias("total")).alias("followers"))
    path = shared_dir(spark, "landed-headers")
    headers.write.mode("overwrite").json(path)
    h = json_scan.header_scan(json_scan.read_json(spark, path, json_scan.HEADER, multiline=False))
    return h.select("name", "description", F.col("owner.display_name").alias("owner_name"),
                    F.size("images").alias("n_images"), F.col("followers.total").alias("followers"))


def _stage_cols(df):
    return df.select("row_id", "name", "artist", rnd("qty", 6).alias("qty"), rnd("price", 6).alias("price"), "cluster")


@query("stage_roundtrip")
def q_stage_roundtrip(spark, d):
    path = sinks.write_stage(_stage_cols(order_items(spark, d)), "order_items")
    return sinks.read_stage(spark, path)


CSV_SCHEMA = ("row_id long, name string, artist string, album string, qty double, price double, cluster int, "
              "x double, y double")


@query("csv_sink")
def q_csv_sink(spark, d):
    oi = order_items(spark, d)
    out = oi.select("row_id", "name", "artist", "album", rnd("qty", 6).alias("qty"), rnd("price", 6).alias("price"),
                    "cluster", rnd(F.coalesce("qty", F.lit(0.0)), 4).alias("x"),
                    rnd(F.coalesce("price", F.lit(0.0)), 4).alias("y"))
    path = sinks.export_clustered_csv(out)
    return spark.read.schema(CSV_SCHEMA).option("header", True).csv(path)


@query("point_export")
def q_point_export(spark, d):
    pts = QUERIES["point_projection"](spark, d)
    path = sinks.export_points(pts)
    return spark.read.schema(pts.schema).json(path)


@query("report_lines")
def q_report_lines(spark, d):
    oi = order_items(spark, d)
    stats = profile.collection_stats(oi, tempo="price", energy="disc", dance="tax", valence="explicit",
                                     duration="lines")
    div = similarity.diversity(load(spark, d, "embeddings"), "embedding").select("diversity")
    prof = profile.cluster_profile(oi, REPORT_PROFILE)
    when = load(spark, d, "orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm").alias("t")).first()["t"]
    lines = sinks.report_lines(REPORT_TITLE, when, "orders", "?", stats, div, prof,
                               REPORT_COLUMNS)
    path = sinks.write_report(lines)
    return sinks.read_report(spark, path)
