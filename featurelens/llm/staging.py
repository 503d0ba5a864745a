"""Shared intermediate tables of the operators."""

from __future__ import annotations

import gc
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelens.session import ensure_code, remove_path, shared_dir


def prepare(spark: SparkSession) -> None:
    """Register the shared folder and ship the package to the executors."""
    shared_dir(spark)
    ensure_code(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: rows go to the shared checkpoint folder and are read from there."""
    prepare(df.sparkSession)
    return df.checkpoint()


@contextmanager
def written(df: DataFrame, name: str, **options: str):
    """A Parquet table in the shared folder for the time of the block.

    For what only intermediate jobs read; the files are removed at the end.
    """
    spark, schema = df.sparkSession, df.schema
    prepare(spark)
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    del df  # or its shuffle files stay
    try:
        yield spark.read.schema(schema).parquet(path)
    finally:
        remove_path(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of shuffles that no DataFrame refers to any more."""
    gc.collect()
    spark.range(1).count()  # the session refers to its last query until it has run another
    spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has (Spark doesn't tell them apart by case), made from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
