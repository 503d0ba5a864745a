"""Stage tables and exports.

Everything is written below the shared checkpoint folder (or a caller's
path) with the DataFrame writer; nothing passes through the driver. Small
reports (a bounded number of lines) are written as one sorted file.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelens.session import shared_dir


def write_stage(df: DataFrame, name: str, path: str | None = None) -> str:
    """Persist a stage table as Parquet; returns its path."""
    out = path or shared_dir(df.sparkSession, f"stage-{name}")
    df.write.mode("overwrite").parquet(out)
    return out


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """Read a stage table; a missing stage is an explicit error."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"stage table not found at {path}; run the pipeline first") from e


def export_clustered_csv(df: DataFrame, base: str | None = None, ts: str | None = None) -> str:
    """The table with its cluster and 2-D coordinates as CSV with a header,
    in a folder named ``collection_clustered_YYYYmmdd_HHMMSS``."""
    stamp = ts or datetime.now().strftime("%Y%m%d_%H%M%S")
    root = base or shared_dir(df.sparkSession, "exports")
    out = f"{root}/collection_clustered_{stamp}"
    df.write.mode("overwrite").option("header", True).csv(out)
    return out


def write_report(lines: DataFrame, base: str | None = None, ts: str | None = None) -> str:
    """Report lines ``(ord, line)`` written as one text file in order."""
    stamp = ts or datetime.now().strftime("%Y%m%d_%H%M%S")
    root = base or shared_dir(lines.sparkSession, "exports")
    out = f"{root}/collection_report_{stamp}"
    lines.repartition(1).sortWithinPartitions("ord").select("line").write.mode("overwrite").text(out)
    return out


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read a written report back as ``(ord, line)``."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.split(F.col("value"), "\n")
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return whole.select(F.posexplode(trimmed).alias("ord", "line"))


def export_points(df: DataFrame, base: str | None = None) -> str:
    """The point layer (coordinates, labels, display values, colour) as JSON."""
    out = base or shared_dir(df.sparkSession, "points")
    df.write.mode("overwrite").json(out)
    return out


# --- fixed values that must equal the analysed program's -----------------
# Report layout: 60-character rules, section headings and summary labels.
REPORT_RULE = "============================================================"
REPORT_SUMMARY_HEADING = "── Summary ──────────────────────────────────────────────────"
REPORT_PROFILE_HEADING = "── Cluster profiles ─────────────────────────────────────────"
REPORT_LABELS = [
    "  Tracks          : ",
    "  Unique artists  : ",
    "  Year range      : ",
    "  Avg BPM         : ",
    "  Avg energy      : ",
    "  Avg valence     : ",
    "  Total duration  : ",
    "  Diversity score : ",
]
# ---------------------------------------------------------------------------


def report_lines(title: str, generated_at: str, name: str, owner: str, stats: DataFrame,
                 diversity: DataFrame, profile: DataFrame, profile_cols) -> DataFrame:
    """S8 content: fixed header, summary lines from the stats row, one line per cluster."""
    spark = stats.sparkSession
    rule = REPORT_RULE
    head = [rule, f"  {title}", f"  {generated_at}", rule, "", f"Collection : {name}", f"Owner      : {owner}", "",
            REPORT_SUMMARY_HEADING]
    fixed = spark.createDataFrame([(i, s) for i, s in enumerate(head)], "ord int, line string")
    s = stats.select("*", diversity.scalar().alias("diversity"))
    lab = REPORT_LABELS
    summary = [
        F.format_string(lab[0] + "%d", "total_tracks"),
        F.format_string(lab[1] + "%d", "unique_artists"),
        F.concat(F.lit(lab[2]), F.coalesce(F.col("year_min").cast("string"), F.lit("N/A")),
                 F.lit(" – "), F.coalesce(F.col("year_max").cast("string"), F.lit("N/A"))),
        F.concat(F.lit(lab[3]), F.coalesce(F.format_string("%.1f", "avg_bpm"), F.lit("N/A"))),
        F.concat(F.lit(lab[4]), F.coalesce(F.format_string("%.3f", "avg_energy"), F.lit("N/A"))),
        F.concat(F.lit(lab[5]), F.coalesce(F.format_string("%.3f", "avg_valence"), F.lit("N/A"))),
        F.format_string(lab[6] + "%.1f min", "total_duration_min"),
        F.format_string(lab[7] + "%.4f", "diversity"),
    ]
    n0 = len(head)
    lines = s.select(F.explode(F.array(*[F.struct(F.lit(n0 + i).alias("ord"), e.alias("line"))
                                          for i, e in enumerate(summary)])).alias("l")).select("l.*")
    n1 = n0 + len(summary)
    mid = spark.createDataFrame([(n1, ""), (n1 + 1, REPORT_PROFILE_HEADING)], "ord int, line string")
    from featurelens.operators.positions import dense_index
    fmt = "  %3d | n=%d" + "".join(f" | {c}=%.3f" for c in profile_cols)
    prof = dense_index(profile, "cluster", out="_r").select(
        (F.lit(n1 + 2) + F.col("_r")).cast("int").alias("ord"),
        F.format_string(fmt, "cluster", "count", *profile_cols).alias("line"))
    k = profile.count()
    tail = spark.createDataFrame([(n1 + 2 + k, "")], "ord int, line string")
    return fixed.unionByName(lines).unionByName(mid).unionByName(prof).unionByName(tail)
