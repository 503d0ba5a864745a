"""Catalogue bindings for the feature-space models (PCA, k-means, choice of
k, density clusters, agglomerative clusters, isolation forest, 2-D
embedding). These are checked by row counts and by property tests; the
ones with an exact SQL form also have an oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.functions.columns import rnd
from featurelens.operators import cluster, features as feat
from featurelens.operators.bisecting import bisecting_tree
from featurelens.operators.density import dbscan, dbscan_vectors
from featurelens.operators.forest import isolation_forest
from featurelens.operators.hierarchy import linkage_rows, ward_rows
from featurelens.plans.catalogue import query
from featurelens.sources.tables import ITEM_FEATURES, load, order_items

KMEANS_K = 6
N_INIT = 12
SEED = 42
K_RANGE = range(2, 11)


def embeddings_2d(spark, d):
    """Embeddings reduced to two centred principal components."""
    e = load(spark, d, "embeddings")
    coords, _, _ = feat.pca(e, k=2, keep=("vec_id", "label"), vec_col="embedding")
    return coords


def item_matrix(spark, d):
    """The standardised feature matrix (M2) of the items."""
    _, matrix, _, names = feat.engineer_features(order_items(spark, d), ITEM_FEATURES, gate=["qty", "price", "disc"])
    return matrix, names


@query("pca")
def q_pca(spark, d):
    matrix, names = item_matrix(spark, d)
    coords, _, _ = feat.pca(matrix, names, k=2)
    return coords.select("row_id", rnd("pc1", 6).alias("pc1"), rnd("pc2", 6).alias("pc2"))


@query("pca_variance")
def q_pca_variance(spark, d):
    matrix, names = item_matrix(spark, d)
    _, ratio, _ = feat.pca(matrix, names, k=2)
    rows = [(i + 1, float(r)) for i, r in enumerate(ratio)]
    return spark.createDataFrame(rows, "component int, explained_variance_ratio double") \
        .select("component", rnd("explained_variance_ratio", 6).alias("explained_variance_ratio"))


@query("kmeans")
def q_kmeans(spark, d):
    return cluster.kmeans(embeddings_2d(spark, d), "vec_id", ["pc1", "pc2"], KMEANS_K, N_INIT, SEED)


@query("optimal_k")
def q_optimal_k(spark, d):
    return cluster.optimal_k(embeddings_2d(spark, d), "vec_id", ["pc1", "pc2"], K_RANGE, N_INIT, SEED)


@query("isolation_forest")
def q_isolation_forest(spark, d):
    matrix, cols = feat.outlier_matrix(order_items(spark, d), ITEM_FEATURES, keep=("row_id",))
    res = isolation_forest(matrix, "row_id", cols, n_trees=200, max_samples=256, contamination=0.05, seed=SEED)
    return res.select("row_id", rnd("anomaly_score", 6).alias("anomaly_score"), "outlier_label")


DBSCAN_EPS = 0.07
DBSCAN_MIN = 3


def part_points(spark, d):
    part = load(spark, d, "part")
    scaled, _ = feat.standardise(part, ["p_size", "p_retailprice"], keep=["p_partkey"])
    return scaled


@query("dbscan")
def q_dbscan(spark, d):
    return dbscan(part_points(spark, d), "p_partkey", ["p_size", "p_retailprice"], DBSCAN_EPS, DBSCAN_MIN)


VECTOR_EPS = 1.12
BISECT_K = 10


@query("dbscan_vectors")
def q_dbscan_vectors(spark, d):
    """Density clusters of the whole vectors."""
    return dbscan_vectors(load(spark, d, "embeddings"), "vec_id", "embedding", VECTOR_EPS, DBSCAN_MIN)


@query("dbscan_summary")
def q_dbscan_summary(spark, d):
    lab = dbscan(part_points(spark, d), "p_partkey", ["p_size", "p_retailprice"], DBSCAN_EPS, DBSCAN_MIN)
    return lab.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
                   F.count(F.when(F.col("cluster") == -1, 1)).alias("n_noise"))


AGG_K = 6


@query("agglomerative")
def q_agglomerative(spark, d):
    """Ward clusters of all parts, merged from the rows themselves."""
    scaled, _ = feat.standardise(load(spark, d, "part"), ["p_size", "p_retailprice"], keep=["p_partkey"])
    return ward_rows(scaled, "p_partkey", ["p_size", "p_retailprice"], AGG_K)


def supplier_points(spark, d):
    scaled, _ = feat.standardise(load(spark, d, "supplier"), ["s_acctbal", "s_nationkey"], keep=["s_suppkey"])
    return scaled


def _linkage_query(linkage):
    def run(spark, d):
        return linkage_rows(supplier_points(spark, d), "s_suppkey", ["s_acctbal", "s_nationkey"], AGG_K, linkage)
    return run


for _linkage in ("single", "average", "complete"):
    query(f"linkage_{_linkage}")(_linkage_query(_linkage))


UMAP_NEIGHBORS = 15
UMAP_MIN_DIST = 0.1
UMAP_METRIC = "euclidean"


@query("embed2d")
def q_embed2d(spark, d):
    from featurelens.operators.embed import embed_2d
    res = embed_2d(load(spark, d, "embeddings"), "vec_id", "embedding", UMAP_NEIGHBORS, UMAP_MIN_DIST, UMAP_METRIC,
                   seed=SEED)
    return res.select("vec_id", rnd("umap_x", 6).alias("umap_x"), rnd("umap_y", 6).alias("umap_y"))


@query("bisecting_tree")
def q_bisecting_tree(spark, d):
    """Top-down clusters of all vectors."""
    labels, _ = bisecting_tree(load(spark, d, "embeddings"), "vec_id", "embedding", BISECT_K)
    return labels
