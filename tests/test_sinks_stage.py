"""Stage tables (reuse and invalidation), exports and grouped top-k planning."""

import os
import time

from pyspark.sql import functions as F

from featurelens.operators.positions import top_k_per_group
from featurelens.sources import sinks
from featurelens.sources.tables import staged


def test_stage_table_is_reused_and_invalidated(spark, tmp_path):
    from featurelens.session import shared_dir

    src = str(tmp_path / "src")
    spark.range(10).write.parquet(src)
    stage_root = os.path.join(shared_dir(spark), "featurelens", "stage")

    def published():
        if not os.path.isdir(stage_root):
            return set()
        return {d for d in os.listdir(stage_root) if d.startswith("probe-") and ".tmp-" not in d}

    before = published()

    def build():
        return spark.read.parquet(src).withColumn("twice", F.col("id") * 2)

    a = staged(spark, "probe", [src], build)
    b = staged(spark, "probe", [src], build)
    assert a.count() == b.count() == 10 and len(published() - before) == 1    # reused
    time.sleep(1.1)
    spark.range(12).write.mode("overwrite").parquet(src)                        # new input version
    c = staged(spark, "probe", [src], build)
    assert c.count() == 12 and len(published() - before) == 2
    d = staged(spark, "probe", [src], lambda: build().withColumn("thrice", F.col("id") * 3))
    assert "thrice" in d.columns and len(published() - before) == 3             # new definition


def test_stage_follows_changed_added_and_removed_files(spark, tmp_path):
    from pathlib import Path

    from featurelens.sources.tables import MANIFEST, fingerprint

    src = tmp_path / "files"
    spark.range(4).coalesce(1).write.parquet(str(src / "a"))
    spark.range(5).coalesce(1).write.parquet(str(src / "b"))

    def read():
        return spark.read.option("recursiveFileLookup", "true").parquet(str(src))

    def now():
        spark.catalog.clearCache()
        return staged(spark, "follow", [str(src)], read)

    first = now()
    assert first.count() == 9 and fingerprint(spark, [str(src)]) == fingerprint(spark, [str(src)])
    manifest = spark.read.parquet(os.path.dirname(first.inputFiles()[0].replace("file://", "")) + f"/{MANIFEST}")
    listed = {(Path(r["path"]).name, r["length"]) for r in manifest.collect()}
    assert listed == {(f.name, f.stat().st_size) for f in src.rglob("part-*.parquet")}
    spark.range(7).coalesce(1).write.parquet(str(src / "c"))  # added
    assert now().count() == 16
    (gone,) = (src / "a").glob("part-*.parquet")
    gone.unlink()  # removed
    assert now().count() == 12
    time.sleep(1.1)
    spark.range(9).coalesce(1).write.mode("overwrite").parquet(str(src / "b"))  # changed
    assert now().count() == 16


def test_csv_and_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5, None), (2, "c", None, 3)], "id long, name string, x double, c int")
    out = sinks.export_clustered_csv(df, base=str(tmp_path), ts="20240101_000000")
    assert os.path.basename(out) == "collection_clustered_20240101_000000"
    back = spark.read.schema(df.schema).option("header", True).csv(out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    lines = spark.createDataFrame([(2, "third"), (0, "first"), (1, "")], "ord int, line string")
    path = sinks.write_report(lines, base=str(tmp_path), ts="t")
    got = [tuple(r) for r in sinks.read_report(spark, path).orderBy("ord").collect()]
    assert got == [(0, "first"), (1, ""), (2, "third")]


def test_missing_stage_is_an_explicit_error(spark, tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError):
        sinks.read_stage(spark, str(tmp_path / "nope"))


def test_grouped_top_k_uses_window_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    top = top_k_per_group(df, "g", [F.col("v").desc()], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.count() == 21
