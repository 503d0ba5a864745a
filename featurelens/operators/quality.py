"""Cluster-quality measures and per-feature separation.

* inertia, Davies-Bouldin: centroids are a (group, dim) partial aggregate;
  row-to-own-centroid distances are an equi-join on the label; the k x k
  centroid comparison is an equi-join over an exploded label list (k rows).
* silhouette (exact, Euclidean): all rows go by each block in a stream, per-row per-cluster distance
  sums, no pair is materialised.
* silhouette (squared Euclidean): closed form from cluster sums, its own name.
* ANOVA F: closed form from per-(feature, cluster) count, mean and variance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.functions.columns import dot, rnd, to_double_array
from featurelens.operators import blocks
from featurelens.operators.similarity import centroids
from featurelens.operators.sizes import SMALL_VALUES, broadcast_if_small


def _euclid(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _with_centroid(df: DataFrame, label: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    cents = broadcast_if_small(centroids(df, label, vec_col), "centroid")
    j = df.select(label, to_double_array(vec_col).alias("_v")).join(cents.select(label, "centroid"), label)
    return j, cents


def inertia(df: DataFrame, label: str, vec_col: str, decimals: int = 2) -> DataFrame:
    """Sum of squared distances of rows to their own centroid."""
    j, _ = _with_centroid(df, label, vec_col)
    d = _euclid(F.col("_v"), F.col("centroid"))
    return j.agg(rnd(F.sum(d * d), decimals).alias("inertia"))


def davies_bouldin(df: DataFrame, label, vec_col: str, decimals: int = 4) -> DataFrame:
    """Mean over clusters of max_j (S_i + S_j) / |c_i - c_j|.

    ``label`` may be a list of labellings: all are evaluated in the same jobs
    (rows are exploded to (labelling, cluster) once) and the result has one
    row per labelling with columns ``labelling``, ``davies_bouldin``.
    """
    many = not isinstance(label, str)
    labels = list(label) if many else [label]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("lab"), F.col(c).cast("long").alias("cl"))
                                for c in labels])).alias("p")
    long = df.select(to_double_array(vec_col).alias("_v"), pairs).select("_v", "p.lab", "p.cl")
    key = ["lab", "cl"]
    ex = long.select(*key, F.posexplode("_v").alias("_i", "_x"))
    per_dim = ex.groupBy(*key, "_i").agg(F.avg("_x").alias("_m"))
    cents = per_dim.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_c")) \
        .select(*key, F.transform("_c", lambda s: s["_m"]).alias("centroid"))
    cents = broadcast_if_small(cents, "centroid")
    spread = long.join(cents, key).groupBy(*key).agg(F.avg(_euclid(F.col("_v"), F.col("centroid"))).alias("s"))
    c = cents.join(spread, key)
    # per labelling, the list of its cluster ids (k entries) exploded into equi-join keys
    ids = c.groupBy("lab").agg(F.collect_list("cl").alias("all"))
    lhs = c.join(ids, "lab").select("lab", F.col("cl").alias("a"), F.col("centroid").alias("ca"),
                                    F.col("s").alias("sa"), F.explode("all").alias("b"))
    lhs = lhs.filter(F.col("a") != F.col("b"))
    rhs = c.select("lab", F.col("cl").alias("b"), F.col("centroid").alias("cb"), F.col("s").alias("sb"))
    r = lhs.join(rhs, ["lab", "b"]).select(
        "lab", "a", F.try_divide(F.col("sa") + F.col("sb"), _euclid(F.col("ca"), F.col("cb"))).alias("r"))
    worst = r.groupBy("lab", "a").agg(F.max("r").alias("m"))
    res = worst.groupBy("lab").agg(rnd(F.avg("m"), decimals).alias("davies_bouldin"))
    if many:
        return res.withColumnRenamed("lab", "labelling")
    return res.select("davies_bouldin")


def silhouette_sums(df: DataFrame, id_col: str, label_cols, vec_col: str,
                    block_rows: int | None = None) -> DataFrame:
    """Per (row, labelling, other cluster): sum of Euclidean distances and count.

    Several labellings (``label_cols``) share one pass over the pairs of rows.
    """
    labels = list(label_cols)
    data = df.select(F.col(id_col).cast("long").alias("_id"), to_double_array(vec_col).alias("_v"),
                     *[F.col(c).cast("long").alias(f"_l{i}") for i, c in enumerate(labels)])
    both, _ = blocks.streamed(data, "_id", data.count(), block_rows)
    nl = len(labels)

    def start(hosts: list[pd.DataFrame]) -> dict:
        # hosts of each batch become a matrix, so that their rows are held once
        return {"id": np.concatenate([p["_id"].to_numpy() for p in hosts]), "x": np.vstack([blocks.stack(p["_v"]) for p in hosts]), "sums": {}, "n": {}}

    def feed(state: dict, part: pd.DataFrame) -> None:
        x = state["x"]
        for s in range(0, len(part), 1024):
            piece = part.iloc[s:s + 1024]
            y, groups, marks = blocks.stack(piece["_v"]), [], []
            for li in range(nl):
                lb = piece[f"_l{li}"].to_numpy()
                for lab in np.unique(lb):
                    groups.append((li, int(lab)))
                    marks.append(lb == lab)
            for g, m in zip(groups, marks):
                state["n"][g] = state["n"].get(g, 0) + int(m.sum())
                if g not in state["sums"]:
                    state["sums"][g] = np.zeros(len(x))
            member = np.stack(marks, axis=1)
            for h in range(0, len(x), 2048):
                dist = blocks.distances(x[h:h + 2048], y)
                if len(groups) <= 128 and np.isfinite(dist).all():
                    added = (dist @ member.astype(float)).T
                else:
                    added = (dist[:, m].sum(axis=1) for m in marks)
                for g, v in zip(groups, added):
                    state["sums"][g][h:h + 2048] += v

    def finish(state: dict):
        for (li, lab), v in state["sums"].items():
            yield pd.DataFrame({"_id": state["id"], "lab": li, "other": lab, "dsum": v, "cnt": state["n"][li, lab]})

    part = both.mapInPandas(lambda batches: blocks.each_block(batches, start, feed, finish), "_id long, lab long, other long, dsum double, cnt long")
    return part.groupBy("_id", "lab", "other").agg(F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt")), data


def silhouette(df: DataFrame, id_col: str, label_cols, vec_col: str,
               block_rows: int | None = None, decimals: int = 4) -> DataFrame:
    """Exact mean silhouette (Euclidean) for each labelling in ``label_cols``.

    ``a`` = mean distance to the other members of the own cluster, ``b`` = the
    smallest mean distance to another cluster; a row alone in its cluster
    scores 0; a labelling with fewer than two clusters gives NULL.
    """
    labels = list(label_cols)
    sums, data = silhouette_sums(df, id_col, labels, vec_col, block_rows)
    own = data.select("_id", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("lab"),
                                                          F.col(f"_l{i}").alias("own"))
                                                 for i in range(len(labels))])).alias("o")).select("_id", "o.*")
    j = sums.join(own, ["_id", "lab"])
    per_row = j.groupBy("_id", "lab").agg(
        F.max(F.when(F.col("other") == F.col("own"), F.col("dsum"))).alias("ds_own"),
        F.max(F.when(F.col("other") == F.col("own"), F.col("cnt"))).alias("n_own"),
        F.min(F.when(F.col("other") != F.col("own"), F.col("dsum") / F.col("cnt"))).alias("b"))
    a = F.try_divide(F.col("ds_own"), F.col("n_own") - 1)
    s = (F.when(F.col("n_own") <= 1, F.lit(0.0))
         .otherwise(F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0))))
    scored = per_row.withColumn("s", s)
    res = scored.groupBy("lab").agg(F.avg("s").alias("sil"), F.count("b").alias("with_other"))
    res = res.withColumn("silhouette", F.when(F.col("with_other") > 0, rnd("sil", decimals)))
    names = F.array(*[F.lit(c) for c in labels])
    return res.select(F.get(names, F.col("lab").cast("int")).alias("labelling"), "silhouette")


#: Clusters that a row meets in one go.
CLUSTER_BLOCK = 256


def silhouette_squared(df: DataFrame, id_col: str, label_cols, vec_col: str, decimals: int = 4) -> DataFrame:
    """A23 for squared Euclidean distances, in closed form: no pairs, work in rows x clusters.

    The mean squared distance of x to a cluster of n rows with sum S and sum of
    squared lengths Q is ``|x|^2 - 2 x.S / n + Q / n`` (n - 1 in place of n for
    its own, x's distance to itself being 0). Vectors are centred on the mean
    of all rows first, which changes no distance and keeps the terms small.
    Clusters come in blocks of ``CLUSTER_BLOCK``; a row meets every block in a
    join, so any number of clusters will do.

    One row per labelling: (labelling, silhouette_squared). A row alone in its
    cluster scores 0, as does one with equal distances; fewer than two clusters
    give NULL. Rows with a null vector, id or label are left out; ids are
    distinct. ``silhouette`` is another measure: its distances aren't squared.
    """
    labels = list(label_cols)
    raw = df.select(F.col(id_col).alias("_id"), to_double_array(vec_col).alias("_v"), *[F.col(c).cast("long").alias(f"_l{i}") for i, c in enumerate(labels)]) \
        .where("_id IS NOT NULL AND _v IS NOT NULL")
    means = raw.select(F.posexplode("_v").alias("_i", "_x")).groupBy("_i").agg(F.avg("_x").alias("m")).orderBy("_i").collect()  # one a dimension
    if not means:
        return df.sparkSession.createDataFrame([(c, None) for c in labels], "labelling string, silhouette_squared double")
    centre = F.array(*[F.lit(r["m"]) for r in means])
    rows = raw.withColumn("_v", F.zip_with("_v", centre, lambda x, m: x - m)).withColumn("_q", dot("_v", "_v"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("lab"), F.col(f"_l{i}").alias("own")) for i in range(len(labels))]))
    rows = rows.select("_id", "_v", "_q", each.alias("o")).select("_id", "_v", "_q", "o.*").where("own IS NOT NULL").checkpoint()

    sums = rows.select("lab", "own", F.posexplode("_v").alias("_i", "_x")).groupBy("lab", "own", "_i").agg(F.sum("_x").alias("s"))
    sums = sums.groupBy("lab", "own").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "s"))), lambda e: e["s"]).alias("s"))
    sizes = rows.groupBy("lab", "own").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_q").alias("q"))
    clusters = sums.join(sizes, ["lab", "own"]).checkpoint()
    blocks_of = clusters.groupBy("lab").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK).cast("int").alias("_blocks"))  # a row a labelling
    block = F.pmod(F.xxhash64("own"), F.col("_blocks")).cast("int").alias("_block")
    cluster = F.struct(F.col("own").alias("of"), "n", "s", "q")
    table = clusters.join(F.broadcast(blocks_of), "lab").select("lab", block, cluster.alias("c"))
    table = broadcast_if_small(table.groupBy("lab", "_block").agg(F.collect_list("c").alias("_all")), "_all", SMALL_VALUES // (len(means) + 3))

    met = rows.join(F.broadcast(blocks_of), "lab").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).join(table, ["lab", "_block"])

    def away(c, less):
        n = c["n"] - less
        return (F.col("_q") * c["n"] - 2 * dot("_v", c["s"]) + c["q"]) / n

    mine = F.get(F.filter("_all", lambda c: c["of"] == F.col("own")), F.lit(0))
    others = F.array_min(F.transform(F.filter("_all", lambda c: c["of"] != F.col("own")), lambda c: away(c, 0)))
    a = F.when(mine["n"] > 1, away(mine, 1))
    scored = met.select("lab", "_id", mine["n"].alias("n"), a.alias("a"), others.alias("b"))
    row = scored.groupBy("lab", "_id").agg(F.max("n").alias("n"), F.max("a").alias("a"), F.min("b").alias("b"))
    row = row.withColumns({c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in ("a", "b")})  # rounding below zero
    s = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    res = row.groupBy("lab").agg(F.avg(s).alias("sil"), F.count("b").alias("others"))
    found = res.select("lab", F.when(F.col("others") > 0, rnd("sil", decimals)).alias("silhouette_squared"))
    names = df.sparkSession.createDataFrame(list(enumerate(labels)), "lab int, labelling string")
    return names.join(F.broadcast(found), "lab", "left").select("labelling", "silhouette_squared")


def anova_f(df: DataFrame, label: str, features, noise=-1, decimals: int = 6) -> DataFrame:
    """One-way ANOVA F per feature across groups (noise excluded);
    undefined or fewer than two groups -> 0."""
    data = df.filter(F.col(label) != F.lit(noise)) if noise is not None else df
    long = data.select(label, *[F.col(f).cast("double").alias(f) for f in features]) \
        .unpivot([label], list(features), "feature", "x").filter(F.col("x").isNotNull())
    g = long.groupBy("feature", label).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"),
                                           F.var_pop("x").alias("v"))
    w = Window.partitionBy("feature")
    # (column names are case-insensitive: keep the totals distinct from "n")
    g = g.withColumn("tot", F.sum("n").over(w)).withColumn("groups", F.count(F.lit(1)).over(w)) \
        .withColumn("gm", F.sum(F.col("n") * F.col("m")).over(w) / F.col("tot"))
    f = g.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"), F.first("tot").alias("tot"), F.first("groups").alias("groups"))
    val = F.try_divide(F.try_divide(F.col("ssb"), F.col("groups") - 1),
                       F.try_divide(F.col("ssw"), F.col("tot") - F.col("groups")))
    val = F.when(F.col("groups") < 2, F.lit(0.0)).otherwise(F.coalesce(val, F.lit(0.0)))
    return f.select("feature", rnd(val, decimals).alias("F_statistic")).orderBy(F.col("F_statistic").desc())
