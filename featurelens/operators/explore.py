"""Explorer operators: range filters, filter domains, colour indices,
presentation projections and top/bottom-N lists.

Filters are plain column predicates (pushed to the Parquet scan when they
touch stored columns); top/bottom-N is ``orderBy(...).limit(n)``, planned as
``TakeOrderedAndProject`` (per-partition top-N, then a final merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions.columns import rnd
from featurelens.operators.positions import dense_index
from featurelens.operators.sizes import broadcast_if_small

# --- fixed values that must equal the analysed program's -----------------
# Categorical palette (cycled) for clusters and artists.
CLUSTER_PALETTE = [
    "#58a6ff", "#3fb950", "#f78166", "#d2a8ff",
    "#ffa657", "#79c0ff", "#56d364", "#ff7b72",
    "#cae8ff", "#7ee787", "#ffa198", "#e3b341",
    "#a5f3fc", "#86efac", "#fca5a5", "#c4b5fd",
    "#67e8f9", "#4ade80", "#f87171", "#a78bfa",
]
ACCENT, ACCENT_RED = "#58a6ff", "#f85149"   # normal / outlier colour
CONTINUOUS_STEPS = 256                       # length of the continuous palette
NULL_DEFAULTS = {"loudness": -10.0}          # per-column fill for presentation; others 0
# ---------------------------------------------------------------------------


def visibility(df: DataFrame, ranges: dict, in_sets: dict | None = None, outlier: str | None = None,
               only_outliers: bool = False, null_default: float = 0.0, out: str = "visible") -> DataFrame:
    """F4 + F11: mark rows inside every inclusive range (NaN passes, NULL is
    compared as ``null_default``), inside every set, and flagged when
    ``only_outliers``. Rows are marked, not dropped (``.filter(out)`` drops)."""
    cond = F.lit(True)
    for c, (lo, hi) in ranges.items():
        v = F.coalesce(F.col(c).cast("double"), F.lit(float(null_default)))
        cond = cond & (F.isnan(v) | ((v >= F.lit(float(lo))) & (v <= F.lit(float(hi)))))
    for c, values in (in_sets or {}).items():
        cond = cond & F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    if only_outliers and outlier is not None:
        cond = cond & F.coalesce(F.col(outlier) == 1, F.lit(False))
    return df.withColumn(out, cond)


def filter_domain(df: DataFrame, columns, year_col: str | None = None, year_expr=None,
                  fallback=(0.0, 1.0), year_fallback=(1900, 2025)) -> DataFrame:
    """(feature, lo, hi) = min/max rounded to 2 decimals, fallback when
    the column has no value; the year bounds are integers."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    if year_col is not None:
        y = year_expr if year_expr is not None else F.col(year_col)
        aggs += [F.min(y).alias("lo__year"), F.max(y).alias("hi__year")]
    row = df.agg(*aggs)
    cells = [F.struct(F.lit(c).alias("feature"),
                      F.coalesce(rnd(F.col(f"lo_{c}"), 2), F.lit(float(fallback[0]))).alias("lo"),
                      F.coalesce(rnd(F.col(f"hi_{c}"), 2), F.lit(float(fallback[1]))).alias("hi"))
             for c in columns]
    if year_col is not None:
        cells.append(F.struct(F.lit(year_col).alias("feature"),
                              F.coalesce(F.col("lo__year"), F.lit(year_fallback[0])).cast("double").alias("lo"),
                              F.coalesce(F.col("hi__year"), F.lit(year_fallback[1])).cast("double").alias("hi")))
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def continuous_index(df: DataFrame, column: str, default: float = 0.0, steps: int = CONTINUOUS_STEPS,
                     out: str = "num_idx") -> DataFrame:
    """Presentation value (NULL -> default, 4 decimals) rescaled by the
    global min/max to a palette index ``int((v-lo)/(hi-lo+1e-9)*(steps-1))``. An empty table stays empty."""
    v = rnd(F.coalesce(F.col(column).cast("double"), F.lit(float(default))), 4)
    b = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if b["lo"] is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    lo, hi = float(b["lo"]), float(b["hi"])
    idx = F.floor((v - F.lit(lo)) / F.lit(hi - lo + 1e-9) * F.lit(steps - 1)).cast("int")
    return df.withColumn(out, idx)


def category_index(df: DataFrame, column: str, order_by: str | None = None, out: str = "cat_idx",
                   palette=CLUSTER_PALETTE, color_out: str | None = None) -> DataFrame:
    """Dense index of a category, in value order or by first ``order_by``;
    optional palette colour (cycled)."""
    key = order_by or column
    firsts = df.groupBy(column).agg(F.min(key).alias("_k"))
    ranks = broadcast_if_small(dense_index(firsts.filter(F.col("_k").isNotNull()), "_k", out=out).drop("_k"))
    res = df.join(ranks, column, "left")
    if color_out:
        pal = F.array(*[F.lit(p) for p in palette])
        res = res.withColumn(color_out, F.get(pal, F.pmod(F.col(out), F.lit(len(palette))).cast("int")))
    return res


def flag_colour(flag, on: str = ACCENT_RED, off: str = ACCENT):
    """Two-way colour from a 0/1 flag."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return F.when(f == 1, F.lit(on)).otherwise(F.lit(off))


def presentation(df: DataFrame, numeric, text=(), keep=(), decimals: int = 4) -> DataFrame:
    """P14 + P25: numeric columns NULL-filled (per-column default) and rounded;
    text columns with '?' for NULL."""
    cols = [*keep]
    for c in numeric:
        cols.append(rnd(F.coalesce(F.col(c).cast("double"), F.lit(NULL_DEFAULTS.get(c, 0.0))), decimals).alias(c))
    for c in text:
        cols.append(F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c))
    return df.select(*cols)


def axis_projection(df: DataFrame, x: str, y: str, keep=()) -> DataFrame:
    """The two chosen columns as (x, y)."""
    return df.select(*keep, F.col(x).alias("x"), F.col(y).alias("y"))


def top_n(df: DataFrame, column: str, n: int = 20, descending: bool = True, pos: str = "pos") -> DataFrame:
    """Largest (or smallest) ``n`` by ``column``; NULLs last both ways; ties by position."""
    if column not in df.columns:
        return df.orderBy(pos).limit(n)
    o = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(o, F.col(pos).asc()).limit(n)


def name_matches(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """P20: case-insensitive regular-expression match; NULL names never match;
    a blank pattern selects nothing to do (rows returned unchanged)."""
    q = pattern.strip().lower()
    if not q:
        return df
    return df.filter(F.coalesce(F.lower(F.col(name)).rlike(q), F.lit(False)))


def first_match(df: DataFrame, name: str, pattern: str, pos: str = "pos") -> DataFrame:
    """T4: first row (by position) whose name matches."""
    return name_matches(df, name, pattern).orderBy(pos).limit(1)
