"""Landed JSON pages -> valid items -> assembled track table."""

import os

from pyspark.sql import functions as F

from featurelens.operators.tracks import assemble_tracks
from featurelens.sources import json_scan
from featurelens.streaming import land_json

from conftest import FIXTURES


def _items(spark):
    pages = json_scan.read_json(spark, os.path.join(FIXTURES, "pages"), json_scan.PAGE) \
        .withColumn("page_no", F.col("_metadata.file_name"))
    return json_scan.page_items(pages, ["page_no"])


def test_page_items_filters_and_unwraps(spark):
    rows = _items(spark).select("page_no", "item_pos", F.col("t.id").alias("id"), F.col("t.name").alias("name"),
                                "added_at", "added_by").orderBy("page_no", "item_pos").collect()
    assert [r.id for r in rows] == ["t1", "t2", "t3", "t4", "t1"]
    assert rows[1].name == "Item Wins"                       # item wins over track
    assert rows[1].added_at == ""


def test_artist_genres(spark):
    ag = json_scan.artist_genres(json_scan.read_json(spark, os.path.join(FIXTURES, "artists"), json_scan.ARTIST_PAGE))
    got = {r.artist_id: r.genres for r in ag.collect()}
    assert got == {"a1": ["rock", "indie rock", "alt", "grunge", "pop"], "a3": [], "a4": []}


def test_envelope_unwrap(spark):
    payloads = ['[{"energy": 0.1}]', '{"content": [{"energy": 0.2}]}', '{"content": [], "data": [{"energy": 0.3}]}',
                '{"audioFeatures": [{"energy": 0.4}]}', '{"other": 1}', '[]']
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    out = df.select(json_scan.unwrap_envelope("p", "struct<energy:double>").alias("l")).collect()
    assert [[x.energy for x in r.l] for r in out] == [[0.1], [0.2], [0.3], [0.4], [], []]


def test_assemble_tracks(spark):
    items = _items(spark)
    feats = spark.createDataFrame([("t1", 0, 0.5, 120.04), ("t1", 1, 0.6, 121.06), ("t4", 0, 0.7, None)],
                                  "id string, feature_pos int, energy double, tempo double")
    genres = json_scan.artist_genres(json_scan.read_json(spark, os.path.join(FIXTURES, "artists"),
                                                         json_scan.ARTIST_PAGE))
    t = assemble_tracks(items, feats, genres, ["energy", "tempo"]).orderBy("page_no", "item_pos").collect()
    first = t[0]
    assert first.artist == "Alpha" and first.all_artists == "Alpha, Beta" and first.artist_id == "a1"
    assert first.energy == 0.6 and first.bpm == 121.1            # last duplicate wins; 1 decimal
    assert first.primary_genre == "rock" and first.genres == "rock | indie rock | alt"
    assert first.release_year == 1999 and first.explicit == 1 and first.duration_min == 3.0
    assert first.added_year == 2021 and first.added_date == "2021-03-04" and first.source_url == "https://example.org/t1"
    no_art = [r for r in t if r.id == "t3"][0]
    assert no_art.artist == "" and no_art.artist_id == "" and no_art.primary_genre == "Unknown"
    assert no_art.release_year is None and no_art.energy is None
    t2 = [r for r in t if r.id == "t2"][0]
    assert t2.genres == "Unknown" and t2.added_date == "?" and t2.explicit == 0


def test_streaming_landing(spark, tmp_path):
    target = str(tmp_path / "bronze")
    land_json(spark, os.path.join(FIXTURES, "pages"), json_scan.PAGE, target, str(tmp_path / "ckpt"))
    landed = spark.read.parquet(target)
    assert landed.count() == 2
    items = json_scan.page_items(landed, ["source_file"])
    assert items.count() == 5


def test_resolve_feature_batches(spark):
    requested = spark.createDataFrame([(f"id{i}", i) for i in range(12)], "id string, pos long")
    b0 = ('{"content": [{"href": "https://x/track/id1", "energy": 0.1}, {"energy": 0.5},'
          ' {"href": "https://x/track/id0", "energy": 0.9}]}')
    b1 = '[{"energy": 0.7}]'
    responses = spark.createDataFrame([(0, b0), (1, b1)], "batch_no long, payload string")
    out = {r.id: (r.energy, r.matched_by) for r in json_scan.resolve_feature_batches(requested, responses).collect()}
    assert out["id0"] == (0.9, "link") and out["id1"] == (0.1, "link")
    assert out["id2"] == (0.9, "position")            # position 2 of batch 0
    assert out["id3"] == (None, "none") and out["id10"] == (0.7, "position") and out["id11"] == (None, "none")
    assert len(out) == 12


def test_absent_genre_source_is_empty_not_an_error(spark, tmp_path):
    g = json_scan.read_artist_genres(spark, str(tmp_path / "no-such-folder"))
    assert g.count() == 0 and g.columns == ["artist_id", "genres"]
    items = _items(spark)
    feats = spark.createDataFrame([], "id string, feature_pos int, energy double")
    t = assemble_tracks(items, feats, g, ["energy"]).collect()
    assert len(t) == 5 and all(r.primary_genre == "Unknown" and r.genres == "Unknown" for r in t)
    assert all(r.bpm == 0.0 for r in t)                       # no tempo column -> constant 0.0
