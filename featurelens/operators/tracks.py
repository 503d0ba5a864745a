"""Track-table assembly.

The lookups (features by item id, genres by primary artist) are left
equi-joins. The build sides are de-duplicated first; whether they are
broadcast is left to AQE's size check because both grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelens.functions.columns import month_short, rnd
from featurelens.operators.positions import dedupe_last


def first_artist(artists: Column) -> list[Column]:
    """P5 + P6: primary artist id/name ('' when none) and all names joined."""
    first = F.get(artists, 0)
    return [F.coalesce(first["id"], F.lit("")).alias("artist_id"),
            F.coalesce(first["name"], F.lit("")).alias("artist"),
            F.coalesce(F.array_join(F.transform(artists, lambda a: a["name"]), ", "), F.lit("")).alias("all_artists")]


def genre_columns(genres: Column, unknown: str = "Unknown") -> list[Column]:
    """P10: first genre and the first three joined by ' | '; 'Unknown' when empty."""
    g = F.coalesce(genres, F.array().cast("array<string>"))
    return [F.coalesce(F.get(g, 0), F.lit(unknown)).alias("primary_genre"),
            F.when(F.size(g) > 0, F.array_join(F.slice(g, 1, 3), " | ")).otherwise(F.lit(unknown)).alias("genres")]


def release_year(release_date: Column) -> Column:
    """Integer of the first four characters, NULL when not a number."""
    return F.substring(release_date, 1, 4).try_cast("int").alias("release_year")


def flag_int(flag: Column) -> Column:
    """Boolean -> 0/1 with missing as 0."""
    return F.coalesce(flag, F.lit(False)).cast("int")


def time_parts(added_at: Column, enabled: bool = True) -> list[Column]:
    """P13 + P24: UTC timestamp (bad -> NULL), year, month, short month and
    'YYYY-MM-DD' ('?' when missing). ``enabled=False`` when every value is ''."""
    if not enabled:
        return [F.lit(None).cast("timestamp").alias("added_at_dt"), F.lit(None).cast("int").alias("added_year"),
                F.lit(None).cast("int").alias("added_month"), F.lit(None).cast("string").alias("month_name"),
                F.lit("?").alias("added_date")]
    ts = F.try_to_timestamp(added_at)
    return [ts.alias("added_at_dt"), F.year(ts).alias("added_year"), F.month(ts).alias("added_month"),
            month_short(F.month(ts)).alias("month_name"),
            F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit("?")).alias("added_date")]


def any_nonempty(df: DataFrame, column: str) -> bool:
    """Guard for P13: is some value different from ''?"""
    return df.filter(F.col(column) != "").limit(1).count() > 0


def derived_units(duration_ms: Column, tempo: Column, has_tempo: bool) -> list[Column]:
    """P11 + P12: minutes with 2 decimals; bpm with 1 decimal or 0.0 when tempo is unusable."""
    return [rnd(duration_ms / 60000, 2).alias("duration_min"),
            (rnd(tempo, 1) if has_tempo else F.lit(0.0)).alias("bpm")]


def assemble_tracks(items: DataFrame, features: DataFrame, genres: DataFrame,
                    feature_cols, order_col: str = "feature_pos", service: str = "web") -> DataFrame:
    """J1 + J2 + P5-P13: one row per valid item.

    ``items`` has a struct column ``t`` (the track) plus ``added_at``,
    ``added_by`` and position keys; ``features`` has ``id``, ``order_col``
    and feature columns (the last record per id wins); ``genres`` has
    one row per ``artist_id`` with ``genres``. ``service`` names the link that
    becomes ``source_url``.
    """
    feats = dedupe_last(features, "id", order_col).drop(order_col)
    g = genres.select("artist_id", "genres")
    base = items.select("*", F.col("t.id").alias("id"), *first_artist(F.col("t.artists")))
    j = base.join(feats, "id", "left").join(g, "artist_id", "left")
    has_tempo = "tempo" in feature_cols and j.filter(F.col("tempo").isNotNull()).limit(1).count() > 0
    enabled = any_nonempty(items, "added_at")
    return j.select(
        *[c for c in items.columns if c not in ("t", "added_at", "added_by")],
        "id", F.col("t.name").alias("name"), "artist", "all_artists", "artist_id",
        F.coalesce(F.col("t.album.name"), F.lit("")).alias("album"),
        release_year(F.col("t.album.release_date")),
        F.coalesce(F.col("t.duration_ms"), F.lit(0)).alias("duration_ms"),
        flag_int(F.col("t.explicit")).alias("explicit"),
        F.coalesce(F.try_element_at(F.col("t.external_urls"), F.lit(service)), F.lit("")).alias("source_url"),
        "added_at", "added_by",
        *genre_columns(F.col("genres")),
        *[F.col(c) for c in feature_cols],
        *derived_units(F.coalesce(F.col("t.duration_ms"), F.lit(0)), F.col("tempo") if "tempo" in feature_cols
                       else F.lit(None).cast("double"), has_tempo),
        *time_parts(F.col("added_at"), enabled))
