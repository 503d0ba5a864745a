"""Catalogue bindings for similarity, cluster quality and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.functions.columns import rnd
from featurelens.operators import explore, features as feat, neighbours, outliers, positions, quality, similarity
from featurelens.operators.score_index import ScoreIndex, write_index
from featurelens.plans.catalogue import query
from featurelens.sources.tables import ITEM_FEATURES, load, order_item_inputs, order_items, publish, stage_path

QUERY_VEC = 0          # vec_id of the query row
K = 5
SEARCH = "blue b.lt"
SIMILAR_N = 10
ANOVA_DIMS = 64         # the whole vector
PCT = 5.0
OUTLIER_TOP = 30


def embeddings(spark, d):
    return load(spark, d, "embeddings")


@query("knn_one")
def q_knn_one(spark, d):
    return similarity.similar_to(embeddings(spark, d), "vec_id", "embedding", QUERY_VEC, K) \
        .select("rank", "vec_id", "similarity")


@query("knn_one_zero_norm")
def q_knn_one_zero_norm(spark, d):
    return similarity.similar_to(embeddings(spark, d), "vec_id", "embedding", QUERY_VEC, K, zero_norm=-2.0) \
        .select("rank", "vec_id", "similarity")


@query("similar_by_name")
def q_similar_by_name(spark, d):
    part = load(spark, d, "part").withColumn("pos", F.col("p_partkey"))
    hit = explore.first_match(part, "p_name", SEARCH).select("p_partkey").collect()
    if not hit:
        return part.limit(0).select(F.lit(0).alias("rank"), "p_partkey", "p_name",
                                    F.lit(0.0).alias("similarity"), "p_size", "p_retailprice")
    scaled, _ = feat.standardise(part, ["p_size", "p_retailprice"], keep=["p_partkey", "p_name", "p_size",
                                                                             "p_retailprice"], suffix="_z")
    vec = scaled.withColumn("v", F.array("p_size_z", "p_retailprice_z"))
    top = similarity.similar_to(vec, "p_partkey", "v", hit[0]["p_partkey"], SIMILAR_N,
                                keep=["p_name", "p_size", "p_retailprice"])
    return top.select("rank", "p_partkey", "p_name", rnd("similarity", 3).alias("similarity"), "p_size",
                      "p_retailprice")


@query("knn_all")
def q_knn_all(spark, d):
    return neighbours.nearest(embeddings(spark, d), "vec_id", "embedding", K)


@query("representatives")
def q_representatives(spark, d):
    return similarity.representatives(embeddings(spark, d), "label", "vec_id", "embedding")


@query("diversity")
def q_diversity(spark, d):
    return similarity.diversity(embeddings(spark, d), "embedding")


def _dims(spark, d):
    e = embeddings(spark, d)
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(ANOVA_DIMS)])


@query("anova_f")
def q_anova_f(spark, d):
    return quality.anova_f(_dims(spark, d), "label", [f"d{i}" for i in range(ANOVA_DIMS)])


@query("davies_bouldin")
def q_davies_bouldin(spark, d):
    return quality.davies_bouldin(embeddings(spark, d), "label", "embedding")


@query("inertia")
def q_inertia(spark, d):
    return quality.inertia(embeddings(spark, d), "label", "embedding")


@query("silhouette_exact")
def q_silhouette_exact(spark, d):
    return quality.silhouette(embeddings(spark, d), "vec_id", ["label"], "embedding").select("silhouette")


@query("silhouette_squared")
def q_silhouette_squared(spark, d):
    return quality.silhouette_squared(embeddings(spark, d), "vec_id", ["label"], "embedding").select("silhouette_squared")


def item_scores(spark, d):
    """score = -sum(z^2) over the median-filled, standardised item features."""
    matrix, cols = feat.outlier_matrix(order_items(spark, d), ITEM_FEATURES, keep=("row_id",))
    score = None
    for c in cols:
        t = F.col(c) * F.col(c)
        score = t if score is None else score + t
    return matrix.select("row_id", (-score).alias("anomaly_score"))


def score_index(spark, d):
    """The items' scores, computed and stored once per version of the tables."""
    path = stage_path(spark, "item_scores", order_item_inputs(d), f"sum of squares of {ITEM_FEATURES}")
    publish(spark, path, lambda tmp: write_index(item_scores(spark, d), "row_id", "anomaly_score", tmp), done="counts/_SUCCESS", inputs=order_item_inputs(d))
    return ScoreIndex(spark, path, "anomaly_score")


@query("rethreshold")
def q_rethreshold(spark, d):
    scored = score_index(spark, d).labelled(PCT)
    return scored.select("row_id", rnd("anomaly_score", 6).alias("anomaly_score"), "outlier_label")


@query("outlier_top")
def q_outlier_top(spark, d):
    scored = outliers.rethreshold(item_scores(spark, d), "anomaly_score", PCT)
    items = order_items(spark, d).join(scored, "row_id")
    cols = ["row_id", "name", "artist", rnd("anomaly_score", 6).alias("anomaly_score"),
            *[rnd(c, 6).alias(c) for c in ["qty", "price", "disc", "tax", "total", "bal"]]]
    return outliers.most_anomalous(items, columns=cols, n=OUTLIER_TOP)


@query("positional_attach")
def q_positional_attach(spark, d):
    oi = order_items(spark, d)
    labels = oi.select("row_id", "cluster")
    scores = outliers.rethreshold(item_scores(spark, d), "anomaly_score", PCT)
    out = positions.attach(oi.select("row_id", "name"), labels, scores)
    return out.select("row_id", "name", "cluster", rnd("anomaly_score", 6).alias("anomaly_score"), "outlier_label")


@query("outlier_share")
def q_outlier_share(spark, d):
    return outliers.outlier_share(outliers.rethreshold(item_scores(spark, d), "anomaly_score", PCT))
