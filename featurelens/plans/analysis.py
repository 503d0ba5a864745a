"""The batch analysis of one collection, end to end (the analysed program's
main run), as Spark jobs with every stage written as a Parquet stage table.

Order of work (same as the analysed program):
1. features: guard, complete cases, median-filled meta column, standardised
   matrix ``X`` (population std);
2. 2-D embedding of ``X`` and the PCA explained variance;
3. clusters on the embedding (k-means, density or agglomerative);
4. outliers on the usable core features (own median fill and scaling),
   cluster profile, most anomalous rows, representatives and diversity on
   ``X``, and the k scan when k-means is used;
5. collection statistics; optional CSV / report exports.

Returns a dict of DataFrames read back from the stage tables (and their
paths), which the explorer-style operators then query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.operators import cluster, explore, outliers, positions, profile, similarity
from featurelens.operators import features as feat
from featurelens.operators.density import dbscan
from featurelens.operators.embed import embed_2d
from featurelens.operators.forest import isolation_forest
from featurelens.operators.hierarchy import agglomerative, linkage_rows
from featurelens.sources import sinks
from featurelens.session import shared_dir

ALGOS = ("kmeans", "dbscan", "hierarchical")


def analyse_collection(items: DataFrame, core, *, meta=("release_year",), include_meta: bool = True,
                       algo: str = "kmeans", n_clusters: int = 6, eps: float = 0.5, min_samples: int = 3,
                       linkage: str = "ward", micro_clusters: int | None = None, n_neighbors: int = 15, min_dist: float = 0.1,
                       metric: str = "euclidean", contamination: float = 0.05, seed: int = 42,
                       stats_columns: dict | None = None, profile_columns=None, export: bool = False,
                       stage_dir: str | None = None, n_epochs: int | None = None) -> dict:
    """Run the whole analysis on ``items`` (needs ``row_id``, ``pos``, ``name``,
    ``artist`` and the ``core`` feature columns). ``hierarchical`` clusters the rows
    themselves; with ``micro_clusters`` it merges so many k-means centres instead."""
    if algo not in ALGOS:
        raise ValueError(f"algo must be one of {ALGOS}")
    spark = items.sparkSession
    root = stage_dir or shared_dir(spark, "analysis")
    out: dict = {"paths": {}}

    def stage(name: str, df: DataFrame) -> DataFrame:
        path = sinks.write_stage(df, name, f"{root}/{name}")
        out["paths"][name] = path
        out[name] = sinks.read_stage(spark, path)
        return out[name]

    core = list(core)
    if items.limit(1).count() == 0:
        raise ValueError("no items: nothing to analyse")

    # 1. features
    clean, matrix, scaler, names = feat.engineer_features(items, core, meta=meta, include_meta=include_meta)
    clean = stage("items_clean", clean)
    x = stage("matrix", matrix.select("row_id", F.array(*[F.col(c) for c in names]).alias("x")))
    stage("scaler", scaler)
    stage("describe", profile.describe_long(clean, [c for c in list(core) + list(meta) if c in clean.columns]))

    # 2. embedding and PCA variance
    emb = stage("embedding", embed_2d(x, "row_id", "x", n_neighbors, min_dist, metric, seed=seed, n_epochs=n_epochs))
    _, ratio, _ = feat.pca(matrix, names, k=2)
    stage("pca_variance", spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratio)],
                                                "component int, explained_variance_ratio double"))

    # 3. clusters on the embedding
    if algo == "kmeans":
        labels = cluster.kmeans(emb, "row_id", ["umap_x", "umap_y"], n_clusters, seed=seed)
    elif algo == "dbscan":
        labels = dbscan(emb, "row_id", ["umap_x", "umap_y"], eps, min_samples)
    else:
        axes = ["umap_x", "umap_y"]
        labels = linkage_rows(emb, "row_id", axes, n_clusters, linkage) if micro_clusters is None else \
            agglomerative(emb, "row_id", axes, n_clusters, linkage, micro_clusters=micro_clusters)
    labels = stage("labels", labels)

    # 4. outliers on the usable core features, summaries
    om, ocols = feat.outlier_matrix(clean, core, keep=("row_id",))
    scores = stage("outlier_scores", isolation_forest(om, "row_id", ocols, contamination=contamination, seed=seed)
                   .select("row_id", "anomaly_score", "outlier_label"))
    base = clean.drop("cluster", "umap_x", "umap_y", "anomaly_score", "outlier_label", "is_outlier")
    table = stage("items_scored", positions.attach(base, labels, emb, scores)
                  .withColumn("is_outlier", F.col("outlier_label") == -1))
    prof_cols = [c for c in (profile_columns or core) if c in table.columns]
    stage("cluster_stats", profile.cluster_profile(table, prof_cols))
    stage("outlier_summary", outliers.most_anomalous(table, columns=["row_id", "name", "artist", "anomaly_score",
                                                                     *prof_cols]))
    stage("outlier_share", outliers.outlier_share(table))
    stage("representatives", similarity.representatives(x.join(labels, "row_id").join(
        clean.select("row_id", "name", "artist"), "row_id"), "cluster", "row_id", "x"))
    stage("diversity", similarity.diversity(x, "x"))
    if algo == "kmeans":
        stage("optimal_k", cluster.optimal_k(emb, "row_id", ["umap_x", "umap_y"], seed=seed))

    # 5. statistics and exports
    sc = stats_columns or {}
    stats = stage("stats", profile.collection_stats(table, **sc))
    if export:
        csv_cols = table.select(*[c for c in table.columns if c not in ("x",)])
        out["paths"]["csv"] = sinks.export_clustered_csv(csv_cols)
        lines = sinks.report_lines("Collection Analysis Report", "", "collection", "?", stats,
                                   out["diversity"].select("diversity"),
                                   profile.cluster_profile(table, prof_cols),
                                   [f"{c}_{s}" for c in prof_cols for s in ("mean", "std")])
        out["paths"]["report"] = sinks.write_report(lines)
        out["paths"]["points"] = sinks.export_points(
            explore.presentation(table, ["umap_x", "umap_y"], text=["name", "artist"], keep=["row_id", "cluster"]))
    return out
