"""Positions, batches, de-duplication and positional joins.

A dense 0..n-1 index over a sort key is the one place a naive plan would use
an unpartitioned window (all rows in one task). ``dense_index`` instead
cuts the key range at approximate quantiles into buckets of about
``rows_per_bucket`` rows, counts each bucket, turns the (small) count table
into offsets, and numbers rows inside their bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, key: str, out: str = "idx", tiebreak=(),
                rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Add ``out`` = 0-based position of each row ordered by numeric ``key``
    (then ``tiebreak``). Rows with a NULL key come last."""
    from pyspark.ml.feature import Bucketizer

    data = df
    n = data.count()
    if n == 0:
        return data.withColumn(out, F.lit(None).cast("long"))
    nb = max(1, -(-n // rows_per_bucket))
    if nb == 1:
        b = data.withColumn("_bk", F.lit(0).cast("long"))
    else:
        # boundaries at approximate quantiles (a bounded-memory sketch), so every
        # bucket holds about n / nb rows however the key values are spread out
        probs = [i / nb for i in range(1, nb)]
        cuts = sorted(set(data.select(F.col(key).cast("double").alias("_k"))
                          .approxQuantile("_k", probs, 1.0 / (10 * nb))))
        splits = [-float("inf")] + cuts + [float("inf")]  # NULL keys get the bucket after the last
        b = Bucketizer(splits=splits, inputCol="_kd", outputCol="_bkd", handleInvalid="keep") \
            .transform(data.withColumn("_kd", F.col(key).cast("double"))) \
            .withColumn("_bk", F.coalesce(F.col("_bkd").cast("long"), F.lit(len(splits)))).drop("_kd", "_bkd")
    counts = b.groupBy("_bk").agg(F.count(F.lit(1)).alias("_c"))
    # the count table has one row per bucket (about n / rows_per_bucket rows)
    offsets = counts.withColumn("_off", F.sum("_c").over(Window.orderBy("_bk")) - F.col("_c")).drop("_c")
    local = F.row_number().over(Window.partitionBy("_bk").orderBy(F.col(key).asc_nulls_last(), *tiebreak)) - 1
    return b.withColumn("_loc", local).join(offsets, "_bk") \
        .withColumn(out, (F.col("_off") + F.col("_loc")).cast("long")).drop("_bk", "_loc", "_off")


def batch_numbers(df: DataFrame, key: str, size: int = 10, tiebreak=()) -> DataFrame:
    """Chunks of ``size`` in key order: ``batch_no`` and ``pos_in_batch``."""
    idx = dense_index(df, key, out="_rn", tiebreak=tiebreak)
    return idx.withColumn("batch_no", F.floor(F.col("_rn") / size).cast("long")) \
        .withColumn("pos_in_batch", F.pmod(F.col("_rn"), F.lit(size)).cast("int")).drop("_rn")


def dedupe_last(df: DataFrame, key, order: str, priority: str | None = None) -> DataFrame:
    """One row per key, the last by ``order`` (lowest ``priority`` first)."""
    keys = [key] if isinstance(key, str) else list(key)
    ords = ([F.col(priority).asc()] if priority else []) + [F.col(order).desc()]
    w = Window.partitionBy(*keys).orderBy(*ords)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def resolve_by_link_or_position(requests: DataFrame, responses: DataFrame, batch: str = "batch_no",
                                req_pos: str = "pos_in_batch", req_id: str = "id",
                                resp_pos: str = "resp_pos", resp_link_id: str = "link_id",
                                payload: str = "payload") -> DataFrame:
    """Each requested id takes the response whose link carries its id in the
    same batch; else the response at the same position in the batch; else NULL.

    Both lookups are equi-joins on batch keys; a link seen twice in a batch
    keeps the later response.
    """
    by_link = dedupe_last(responses.filter(F.col(resp_link_id).isNotNull()), [batch, resp_link_id], resp_pos)
    by_link = by_link.select(F.col(batch), F.col(resp_link_id).alias(req_id), F.col(payload).alias("_p_link"),
                             F.lit(True).alias("_hit_link"))
    by_pos = responses.select(F.col(batch), F.col(resp_pos).alias(req_pos), F.col(payload).alias("_p_pos"),
                              F.lit(True).alias("_hit_pos"))
    j = requests.join(by_link, [batch, req_id], "left").join(by_pos, [batch, req_pos], "left")
    link = F.col("_hit_link").isNotNull()
    how = (F.when(link, F.lit("link")).when(F.col("_hit_pos").isNotNull(), F.lit("position"))
           .otherwise(F.lit("none")))
    return j.withColumn(payload, F.when(link, F.col("_p_link")).otherwise(F.col("_p_pos"))) \
        .withColumn("matched_by", how).drop("_p_link", "_p_pos", "_hit_link", "_hit_pos")


def attach(items: DataFrame, *parts: DataFrame, key: str = "row_id") -> DataFrame:
    """Attach per-row results (labels, scores, coordinates) by key, never by order."""
    out = items
    for p in parts:
        out = out.join(p, key, "left")
    return out


def top_k_per_group(df: DataFrame, group, order_cols, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group (planned as a WindowGroupLimit)."""
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(*order_cols)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
