"""Broadcasts behind a counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_VALUES = 1_000_000


def broadcast_if_small(df: DataFrame, array_col: str | None = None, limit: int = SMALL_VALUES) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``limit`` values, else without.

    The table is written to the shared folder first, so that it is computed
    once and what is counted is what is joined. A value is a cell, or an
    element of ``array_col``.
    """
    table = df.checkpoint()
    extra = F.coalesce(F.sum(F.size(array_col)), F.lit(0)) if array_col else F.lit(0)
    values = table.agg((F.count(F.lit(1)) * len(table.columns) + extra).alias("n")).first()["n"]
    return F.broadcast(table) if values <= limit else table
