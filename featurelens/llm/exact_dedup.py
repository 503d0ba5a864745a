"""Exact deduplication by a tree of digest-run merges (operator 2).

Every input partition is a run of (digest, best row, count) entries, one per
distinct text. In each round the runs whose numbers agree above the next
``log2(fan_in)`` bits are merged: an aggregation on (parent run, digest),
which Spark executes as a merge of sorted entries, keeps the best row and the
sum of counts. Numbers shrink by ``fan_in`` a round until one run is left. The
way back hands the result of each digest down the same tree. An entry has at
most ``fan_in`` entries below it and a leaf only the rows of one partition, so
no key gathers a large group however often a text is repeated. Texts don't
move; entries are about 60 bytes.

Entries are equal when SHA-256, byte length and an independent 64-bit hash of
the normalised text all agree (the verification at every level).

Defined results: null text counts as empty; texts are equal when identical
after lower-casing A-Z. ``keep`` says whether the smallest or the largest id
stays; null ids lose to any other; among rows with the same text and id one
(the first or last in input order) stays. Other columns and their names don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.llm.staging import cut, fresh, text_or_empty
from featurelens.operators.sizes import broadcast_if_small

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEW_VALUES = 4_000_000
_ENTRY = ("digest", "n_bytes", "check")


def normalised(column: str = "text"):
    return F.translate(text_or_empty(column), UPPER, UPPER.lower())


def digest_rows(df: DataFrame, id_col: str, text_col: str, extra=()) -> DataFrame:
    """One slim row per document: id, row number (its high bits are the partition), run and digests."""
    text = df.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_t"), *[F.col(c) for c in extra])
    return text.select(
        "_id", *extra, F.monotonically_increasing_id().alias("_row"), F.spark_partition_id().cast("long").alias("_run"),
        F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("digest"),
        F.octet_length("_t").cast("long").alias("n_bytes"), F.xxhash64("_t").alias("check"))


def merge_tree(rows: DataFrame, keep: str = "min", fan_in: int = 8) -> DataFrame:
    """Entries of the leaf runs with the result of their digest: ``best`` (_id, _row) and ``copies``.

    ``rows`` holds ``digest_rows``' columns and is read more than once.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max: {keep!r}")
    if fan_in < 2:
        raise ValueError(f"fan_in must be 2 or more: {fan_in}")
    # null ids must lose: they sort first, so the smallest is taken over (is null, id)
    candidate = F.struct(F.col("_id").isNull().alias("none") if keep == "min" else F.col("_id").isNotNull().alias("some"),
                         F.col("_id"), F.col("_row"))
    pick = F.min if keep == "min" else F.max
    level = cut(rows.groupBy("_run", *_ENTRY).agg(pick(candidate).alias("best"), F.count(F.lit(1)).alias("copies")))
    last = rows.agg(F.max("_run")).first()[0] or 0
    rounds = math.ceil(math.log(last + 1, fan_in)) if last else 0
    levels = [level]
    for _ in range(rounds):
        parents = level.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("long"))
        level = cut(parents.groupBy("_run", *_ENTRY).agg(pick("best").alias("best"), F.sum("copies").alias("copies")))
        levels.append(level)
    result = levels.pop()
    while levels:
        below = levels.pop().select("_run", F.floor(F.col("_run") / fan_in).cast("long").alias("_up"), *_ENTRY)
        above = result.withColumnRenamed("_run", "_up")
        result = below.join(above, ["_up", *_ENTRY]).select("_run", *_ENTRY, "best", "copies")
    return result


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 8) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = cut(digest_rows(df, id_col, text_col))
    tree = merge_tree(rows, keep, fan_in)
    return rows.join(tree, ["_run", *_ENTRY]).select(
        F.col("_id").alias(id_col), F.col("best._id").alias("keep_id"), F.col("copies").alias("group_size"),
        (F.col("_row") == F.col("best._row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 8) -> DataFrame:
    """The rows of ``df`` that stay, with their columns.

    Rows are told by id and a 64-bit hash of the text as it is. Those that go are
    taken out by an anti-join, with a broadcast if a count shows that they are few;
    texts aren't shuffled then. Of rows that agree in id and text, which stay or go
    together, one is kept (any, if other columns differ); only such rows are reduced.
    """
    (raw,) = fresh(df, "_raw")
    named = df.select(id_col, text_col, F.xxhash64(text_or_empty(text_col)).alias(raw))
    rows = cut(digest_rows(named, id_col, text_col, extra=[raw]))
    found = rows.join(merge_tree(rows, keep, fan_in), ["_run", *_ENTRY])
    pairs = cut(found.groupBy("_id", raw).agg(F.max(F.col("_row") == F.col("best._row")).alias("_kept"), F.count(F.lit(1)).alias("_rows")))
    name, there = fresh(df, "_gone_id", "_gone_raw")

    def among(which: DataFrame, how: str) -> DataFrame:
        known = broadcast_if_small(which.select(F.col("_id").alias(name), F.col(raw).alias(there)), limit=FEW_VALUES)
        return df.join(known, (F.xxhash64(text_or_empty(text_col)) == F.col(there)) & F.col(id_col).eqNullSafe(F.col(name)), how)

    again = pairs.where("_kept AND _rows > 1")
    if again.isEmpty():
        return among(pairs.where("NOT _kept"), "left_anti")
    columns = F.struct(*[F.col(c) for c in df.columns])
    one = among(again, "left_semi").groupBy(F.col(id_col).alias(name), F.xxhash64(text_or_empty(text_col)).alias(there)).agg(F.first(columns).alias(raw))
    return among(pairs.where("NOT _kept OR _rows > 1"), "left_anti").unionByName(one.select(f"{raw}.*"))
