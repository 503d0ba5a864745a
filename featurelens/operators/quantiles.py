"""Exact percentiles (linear interpolation) without collecting a group.

Spark's ``percentile`` keeps every distinct value of a group in one buffer,
which does not survive a group holding a third of 100 TB. Here every pass
is a scan with a partial aggregate:

1. per group: ``n``, ``min``, ``max``; each requested ``p`` needs the order
   statistics at ranks ``floor(p(n-1))`` and ``ceil(p(n-1))`` (0-based).
2. per (group, rank) a value bracket ``[lo, hi]`` with the number of values
   below it is narrowed: values inside are bucketed into ``buckets`` equal
   slices, counted with min/max per slice, and the slice holding the rank
   becomes the new bracket (its exact min/max, so membership stays exact).
3. once a bracket holds at most ``max_collect`` values (or one distinct
   value) those few values are sorted and the rank is read off.

Results equal numpy's / pandas' linear-interpolation percentile and
DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

import math
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.operators.sizes import broadcast_if_small

MAX_PASSES = 40


def exact_percentiles(df: DataFrame, value: str, probs, group_cols=(), buckets: int = 4096,
                      max_collect: int = 20_000, prefix: str = "p") -> DataFrame:
    """One row per group: group columns, ``n`` and one column per probability.

    Column names are ``f"{prefix}{i}"`` in the order of ``probs``. Groups
    with no non-null value are absent. ``probs`` are plain floats in [0, 1].
    """
    group_cols = list(group_cols)
    probs = [float(p) for p in probs]
    if not group_cols:
        return _global_percentiles(df, value, probs, buckets, max_collect, prefix)
    data = df.select(*group_cols, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    data = data.filter(~F.isnan("_v"))

    stats = data.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"),
                                          F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    # target ranks per (group, prob)
    rank_exprs = []
    for i, p in enumerate(probs):
        r = F.lit(p) * (F.col("n") - 1)
        rank_exprs.append(F.struct(F.lit(i).alias("pi"), F.floor(r).cast("long").alias("rlo"),
                                   F.ceil(r).cast("long").alias("rhi"),
                                   (r - F.floor(r)).alias("frac")))
    plan = stats.select(*group_cols, "n", "_mn", "_mx", F.explode(F.array(*rank_exprs)).alias("t"))
    plan = plan.select(*group_cols, "n", "_mn", "_mx", "t.pi", "t.rlo", "t.rhi", "t.frac")
    targets = (plan.select(*group_cols, "n", "_mn", "_mx", F.col("rlo").alias("rank"))
               .union(plan.select(*group_cols, "n", "_mn", "_mx", F.col("rhi").alias("rank")))
               .distinct())
    # the first bracket is the whole group: small groups go straight to the final sort
    state = targets.select(*group_cols, "rank", F.col("_mn").alias("lo"), F.col("_mx").alias("hi"),
                           F.lit(0).cast("long").alias("below"),
                           F.col("n").cast("long").alias("cnt")).checkpoint()

    for _ in range(MAX_PASSES):
        open_ = state.filter((F.col("lo") < F.col("hi")) & (F.col("cnt").isNull() | (F.col("cnt") > max_collect)))
        if open_.isEmpty():
            break
        brackets = broadcast_if_small(open_.select(*group_cols, "lo", "hi", "below").distinct())
        j = data.join(brackets, on=group_cols).filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        b = F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets),
                    F.lit(buckets - 1))
        hist = (j.withColumn("_b", b)
                .groupBy(*group_cols, "below", "_b")
                .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("bmn"), F.max("_v").alias("bmx")))
        w = Window.partitionBy(*group_cols, "below").orderBy("_b")
        hist = hist.withColumn("cum", F.sum("c").over(w) - F.col("c"))
        picked = hist.join(open_.select(*group_cols, "rank", "below"), group_cols + ["below"]).filter(
            (F.col("below") + F.col("cum") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("cum") + F.col("c")))
        picked = picked.select(*group_cols, "rank", F.col("bmn").alias("lo"), F.col("bmx").alias("hi"),
                               (F.col("below") + F.col("cum")).alias("below"), F.col("c").alias("cnt"))
        done = state.join(open_.select(*group_cols, "rank"), on=group_cols + ["rank"], how="left_anti")
        state = done.unionByName(picked).checkpoint()
    else:
        raise RuntimeError("exact_percentiles did not converge")

    # resolve each rank: a single-valued bracket is its value; else sort the few values
    single = state.filter(F.col("lo") == F.col("hi")).select(*group_cols, "rank", F.col("lo").alias("val"))
    multi = state.filter(F.col("lo") < F.col("hi"))
    brackets = broadcast_if_small(multi.select(*group_cols, "lo", "hi", "below").distinct())
    lists = (data.join(brackets, on=group_cols)
             .filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
             .groupBy(*group_cols, "below").agg(F.sort_array(F.collect_list("_v")).alias("vals")))
    few = lists.join(multi.select(*group_cols, "rank", "below"), group_cols + ["below"]).select(
        *group_cols, "rank", F.element_at("vals", (F.col("rank") - F.col("below") + 1).cast("int")).alias("val"))
    vals = single.unionByName(few)

    lo_v = vals.select(*group_cols, F.col("rank").alias("rlo"), F.col("val").alias("vlo"))
    hi_v = vals.select(*group_cols, F.col("rank").alias("rhi"), F.col("val").alias("vhi"))
    res = plan.select(*group_cols, "n", "pi", "rlo", "rhi", "frac") \
        .join(lo_v, on=group_cols + ["rlo"]).join(hi_v, on=group_cols + ["rhi"])
    res = res.withColumn("q", F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac"))
    aggs = [F.max(F.when(F.col("pi") == i, F.col("q"))).alias(f"{prefix}{i}") for i in range(len(probs))]
    return res.groupBy(*group_cols, "n").agg(*aggs)


def values_at(data: DataFrame, ranks, lo: float, hi: float, below: int, cnt: int, buckets: int = 4096, max_collect: int = 20_000) -> dict:
    """Order statistics of the column ``_v``: {rank: value} for ranks all inside the bracket
    [lo, hi], which holds ``cnt`` values and has ``below`` before it."""
    for _ in range(MAX_PASSES):
        if lo == hi:
            return {r: lo for r in ranks}
        inside = data.filter((F.col("_v") >= F.lit(lo)) & (F.col("_v") <= F.lit(hi)))
        if cnt <= max_collect:
            vals = sorted(r[0] for r in inside.collect())
            return {r: vals[r - below] for r in ranks}
        b = F.least(F.floor((F.col("_v") - F.lit(lo)) / F.lit(hi - lo) * buckets), F.lit(buckets - 1))
        hist = inside.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("bmn"),
                                                F.max("_v").alias("bmx")).orderBy("b").collect()
        homes, cum = {}, below
        for h in hist:
            for r in ranks:
                if cum <= r < cum + h["c"]:
                    homes[r] = (float(h["bmn"]), float(h["bmx"]), cum, int(h["c"]))
            cum += h["c"]
        if len(set(homes.values())) > 1:        # ranks now in different slices: go on separately
            out: dict = {}
            for r in ranks:
                out.update(values_at(data, [r], *homes[r], buckets, max_collect))
            return out
        lo, hi, below, cnt = homes[ranks[0]]
    raise RuntimeError("exact_percentiles did not converge")


def _global_percentiles(df: DataFrame, value: str, probs, buckets: int, max_collect: int,
                        prefix: str) -> DataFrame:
    """Ungrouped case: the brackets are plain literals, so each pass is one
    filtered scan with a partial aggregate and no join."""
    data = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    st = data.agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("mn"), F.max("_v").alias("mx")).first()
    spark = df.sparkSession
    schema = "n long, " + ", ".join(f"{prefix}{i} double" for i in range(len(probs)))
    n = int(st["n"])
    if n == 0:
        return spark.createDataFrame([], schema)
    row = [n]
    for p in probs:
        r = p * (n - 1)
        rlo, rhi = math.floor(r), math.ceil(r)
        got = values_at(data, sorted({rlo, rhi}), float(st["mn"]), float(st["mx"]), 0, n, buckets, max_collect)
        vlo, vhi = got[rlo], got[rhi]
        row.append(vlo + (vhi - vlo) * (r - rlo))
    return spark.createDataFrame([tuple(row)], schema)


def exact_percentile_scalars(df: DataFrame, value: str, probs) -> list:
    """Global percentiles as Python floats (None when the column is all null)."""
    rows = exact_percentiles(df, value, probs).collect()
    if not rows:
        return [None for _ in probs]
    return [rows[0][f"p{i}"] for i in range(len(probs))]


def column_percentiles(df: DataFrame, columns, probs, buckets: int = 4096, max_collect: int = 20_000) -> dict:
    """Exact percentiles of whole columns: column -> list of floats (None where it has no value).

    All columns advance together: a pass is one scan in which each value is
    put into a slice of the open brackets of its column (literals, no join),
    with a partial aggregate; ranks in the same bracket share it. What comes
    back is ``buckets`` rows a bracket, and at the end at most
    ``max_collect`` values a bracket.
    """
    cols, probs = list(columns), [float(p) for p in probs]
    if not cols:
        return {}
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(cols)]
    data = df.select(*clean)
    aggs = []
    for i in range(len(cols)):
        aggs += [F.count(f"_{i}").alias(f"n{i}"), F.min(f"_{i}").alias(f"a{i}"), F.max(f"_{i}").alias(f"b{i}")]
    row = data.agg(*aggs).first()
    values: dict[tuple[int, int], float] = {}
    state = {}  # (column, rank) -> lo, hi, values below, values inside
    for i in range(len(cols)):
        n = row[f"n{i}"]
        for p in probs if n else []:
            for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                state[i, r] = (row[f"a{i}"], row[f"b{i}"], 0, n)
    for _ in range(MAX_PASSES):
        values |= {k: s[0] for k, s in state.items() if s[0] == s[1]}
        state = {k: s for k, s in state.items() if s[0] < s[1]}
        if not state:
            break
        brackets = sorted({(k[0], *s) for k, s in state.items()})
        few = all(b[4] <= max_collect for b in brackets)

        def cell(number: int, bracket) -> F.Column:
            i, lo, hi, _, _ = bracket
            v = F.col(f"_{i}")
            at = v if few else F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * buckets), F.lit(buckets - 1)).cast("double")
            return F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), F.struct(F.lit(number).alias("k"), at.alias("at"), v.alias("v")))

        cells = data.select(F.explode(F.array(*[cell(j, b) for j, b in enumerate(brackets)])).alias("c")).where("c IS NOT NULL").select("c.*")
        rows = cells.groupBy("k", "at").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "at").collect()
        homes: dict[int, list] = {}
        for r in rows:
            homes.setdefault(r["k"], []).append(r)
        for key in list(state):
            number = brackets.index((key[0], *state[key]))
            below = state[key][2]
            for r in homes[number]:
                if below <= key[1] < below + r["c"]:
                    state[key] = (r["lo"], r["hi"], below, r["c"])
                    break
                below += r["c"]
    if state:
        raise RuntimeError("column_percentiles did not converge")
    out = {}
    for i, c in enumerate(cols):
        n, found = row[f"n{i}"], []
        for p in probs:
            r = p * (n - 1) if n else 0.0
            lo = values.get((i, math.floor(r))) if n else None
            found.append(None if lo is None else lo + (values[i, math.ceil(r)] - lo) * (r - math.floor(r)))
        out[c] = found
    return out


def exact_medians(df: DataFrame, columns) -> dict:
    """Median of each column (global), as a dict of Python floats."""
    return {c: v[0] for c, v in column_percentiles(df, columns, [0.5]).items()}


def unpivot(df: DataFrame, columns, name_col: str = "feature", value_col: str = "value",
            ids=()) -> DataFrame:
    """Wide -> long over ``columns`` (values cast to double), keeping ``ids``."""
    ids = list(ids)
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]) \
        .unpivot(ids, list(columns), name_col, value_col)

