"""Feature guards, cleaning, imputation, standardisation and PCA.

Table-level facts (which columns are usable, means, deviations, medians,
the d x d covariance) are computed by one aggregate job each and handed back
as Python scalars; the row-level work stays a lazy, codegen-friendly
projection with those scalars as literals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.operators.quantiles import exact_medians


def available_columns(df: DataFrame, columns) -> list[str]:
    """columns that exist and hold at least one non-null value (one pass)."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return []
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in present]).first()
    return [c for c in present if row[c] > 0]


def complete_cases(df: DataFrame, columns) -> DataFrame:
    """drop rows with a null in any of ``columns``."""
    return df.na.drop(subset=list(columns))


def median_fill(df: DataFrame, columns) -> DataFrame:
    """A3: replace nulls by the exact column median (linear interpolation)."""
    cols = list(columns)
    if not cols:
        return df
    med = exact_medians(df, cols)
    out = df
    for c in cols:
        filled = F.col(c).cast("double")
        if med[c] is not None:
            filled = F.coalesce(filled, F.lit(float(med[c])))
        out = out.withColumn(c, filled)
    return out


def moments(df: DataFrame, columns) -> dict:
    """Mean and population std of each column in one aggregate pass."""
    cols = list(columns)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standardise(df: DataFrame, columns, keep=(), suffix: str = "") -> tuple[DataFrame, DataFrame]:
    """M1: z-scores with the population std; a constant column becomes 0.

    Returns ``(scaled, scaler)`` where ``scaler`` is ``(feature, mean, std_pop)``.
    """
    cols = list(columns)
    mom = moments(df, cols)
    exprs = []
    for c in cols:
        m, s = mom[c]
        m = 0.0 if m is None else float(m)
        s = 0.0 if s is None else float(s)
        x = F.col(c).cast("double") - F.lit(m)
        exprs.append((x / F.lit(s) if s > 0 else x * F.lit(0.0)).alias(c + suffix))
    scaled = df.select(*keep, *exprs)
    spark = df.sparkSession
    scaler = spark.createDataFrame([(c, None if mom[c][0] is None else float(mom[c][0]),
                                     None if mom[c][1] is None else float(mom[c][1])) for c in cols],
                                   "feature string, mean double, std_pop double")
    return scaled, scaler


def engineer_features(df: DataFrame, core, meta=("release_year",), include_meta: bool = True,
                      gate=None, fallback=("release_year", "duration_min", "explicit"),
                      keep=("row_id",)):
    """M2: guard -> complete cases -> median-fill meta -> standardise.

    ``gate`` lists the columns whose availability decides the audio path
    (default: the first three core columns). When any is unusable the
    metadata fallback (M3) is returned instead.
    Returns ``(clean_rows, matrix, scaler, feature_names)``.
    """
    core = list(core)
    gate = list(gate) if gate else core[:3]
    if len(available_columns(df, gate)) < len(gate):
        return metadata_matrix(df, fallback, keep)
    clean = complete_cases(df, core)
    names = list(core)
    if include_meta:
        meta_cols = [c for c in meta if c in df.columns]
        if meta_cols:
            clean = median_fill(clean, meta_cols)
            names += meta_cols
    matrix, scaler = standardise(clean, names, keep=keep)
    return clean, matrix, scaler, names


def metadata_matrix(df: DataFrame, columns=("release_year", "duration_min", "explicit"),
                    keep=("row_id",), required="duration_min"):
    """M3: median-fill the metadata columns, drop rows without ``required``, standardise."""
    cols = [c for c in columns if c in df.columns]
    filled = median_fill(df, cols)
    if required in filled.columns:
        filled = complete_cases(filled, [required])
    matrix, scaler = standardise(filled, cols, keep=keep)
    return filled, matrix, scaler, cols


def outlier_matrix(df: DataFrame, columns, keep=("row_id",)) -> tuple[DataFrame, list[str]]:
    """M4: usable columns only, median-filled, own standardisation."""
    cols = available_columns(df, columns)
    if not cols:
        raise ValueError("no usable feature column for the outlier matrix")
    filled = median_fill(df, cols)
    matrix, _ = standardise(filled, cols, keep=keep)
    return matrix, cols


def covariance(df: DataFrame, columns) -> np.ndarray:
    """Sample covariance matrix (d x d) from one aggregate pass."""
    cols = list(columns)
    d = len(cols)
    aggs = [F.covar_samp(cols[i], cols[j]).alias(f"c_{i}_{j}") for i in range(d) for j in range(i, d)]
    row = df.agg(*aggs).first()
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v = row[f"c_{i}_{j}"]
            cov[i, j] = cov[j, i] = 0.0 if v is None else v
    return cov


def pca(df: DataFrame, columns=None, k: int = 2, keep=("row_id",), vec_col: str | None = None):
    """M5: centred PCA. Returns ``(coords, explained_variance_ratio, loadings)``.

    Components come from ``pyspark.ml.feature.PCA`` (a distributed Gramian
    pass; only the d x d matrix is decomposed on the driver). Its transform
    projects uncentred rows, so the projection here subtracts the column
    means first; it is one flat array expression with literal weights.
    Component signs are fixed so the largest-magnitude loading is positive.
    Without rows there are no coordinates and no ratios, and the loadings are 0.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    arr = F.col(vec_col).cast("array<double>") if vec_col else F.array(*[F.col(c).cast("double") for c in columns])
    data = df.select(*keep, arr.alias("_arr")).filter(F.col("_arr").isNotNull())
    one = data.select("_arr").first()
    if one is None:
        return data.select(*keep, *[F.lit(0.0).alias(f"pc{j + 1}") for j in range(k)]), [], np.zeros((len(columns or []), k))
    d = len(one["_arr"])
    means = data.select(*[F.avg(F.col("_arr")[i]).alias(f"m{i}") for i in range(d)]).first()
    mean = np.array([float(means[f"m{i}"]) for i in range(d)])
    model = PCA(k=k, inputCol="_vec").fit(data.select(array_to_vector("_arr").alias("_vec")))
    vecs = model.pc.toArray().copy()
    for j in range(vecs.shape[1]):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    ratio = [float(v) for v in model.explainedVariance.toArray()[:k]]
    centred = F.zip_with("_arr", F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    exprs = []
    for j in range(k):
        w = F.array(*[F.lit(float(vecs[i, j])) for i in range(d)])
        exprs.append(F.aggregate(F.zip_with(centred, w, lambda a, b: a * b), F.lit(0.0),
                                 lambda acc, v: acc + v).alias(f"pc{j + 1}"))
    return data.select(*keep, *exprs), ratio, vecs
