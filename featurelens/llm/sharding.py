"""Stratified shards by fractional rank (operator 9).

Within each source the rows are put in a seeded random order (by a digest of
seed and id). The row of rank r of n gets the fraction (2r + 1) / 2n, all rows
are sorted by fraction, and the sorted list is cut into shards of equal counts
(at most one apart: the ``rows`` law). Neighbours in the list come from the
sources in proportion to their sizes, so every shard holds the mixture.

Ranks are exact and never gather a source in one task: the digest is uniform,
so (source, digest range) buckets, as many as a source's size asks for, hold
about ``bucket_rows`` rows; counts per bucket, summed up, give each bucket its first
rank. The same holds for fractions, which are uniform by construction. Only
slim rows are shuffled; texts stay in the scan.

Defined results: null source is a stratum of its own; null text has size 1;
rows that tie in digest (repeated ids) are ordered by id, text checksum and
size, and are interchangeable beyond that. An empty table gives an empty
result, and fewer rows than shards leave the last shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelens.llm.staging import cut, text_or_empty
from featurelens.operators.sizes import broadcast_if_small

_BITS = 60


def seeded_order(id_col: str, seed: int):
    """60 uniform bits from seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long")


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Add the exact rank (from 0) within ``group``; ``bucket`` must not decrease along ``order``."""
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*group).orderBy(bucket)
    first = counts.withColumn("_first", F.sum("_n").over(along) - F.col("_n"))
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    return (rows.join(first.drop("_n"), [*group, bucket])
            .withColumn(out, F.col("_first") + F.row_number().over(within) - 1).drop("_first"))


def stratified_shards(df: DataFrame, shards: int, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                      seed: int = 17, bucket_rows: int = 2_000) -> DataFrame:
    """One row per document: id, source, size, text_crc32, ``position`` in the mixed order, shard and slot."""
    if shards < 1:
        raise ValueError(f"shards must be 1 or more: {shards}")
    text = text_or_empty(text_col)
    rows = cut(df.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        F.col(source_col).isNull().alias("_none"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), seeded_order(id_col, seed).alias("_h")))
    total = rows.count()
    ties = ["_id", "text_crc32", "size"]
    sizes = rows.groupBy("_source", "_none").agg(F.count(F.lit(1)).alias("_of"))
    # as many buckets as the source's rows need; equal ranges of the digest
    width = F.ceil(F.lit(float(1 << _BITS)) / F.ceil(F.col("_of") / bucket_rows)).cast("long")
    # few sources are broadcast; if they are many the join deals rows by source, so they are dealt anew by bucket
    rows = rows.join(broadcast_if_small(sizes), ["_source", "_none"]).withColumn("_w", width).withColumn("_b", F.expr("_h div _w"))
    rows = rows.repartition("_source", "_none", "_b")
    ranked = _ranked(rows, ["_source", "_none"], "_b", ["_h", *ties], "_rank").drop("_b")
    ranked = ranked.withColumn("_f", (2 * F.col("_rank") + 1) / (2 * F.col("_of")))
    buckets = max(1, -(-total // bucket_rows))
    ranked = ranked.withColumns({"_b": F.floor(F.col("_f") * buckets).cast("long"), "_all": F.lit(0)})
    mixed = _ranked(ranked, ["_all"], "_b", ["_f", "_source", "_none", "_h", *ties], "position")
    shard = F.expr(f"(position * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (mixed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - first)
            .select(F.col("_id").alias(id_col), F.when(~F.col("_none"), F.col("_source")).alias(source_col),
                    "size", "text_crc32", "position", "shard", "slot"))
