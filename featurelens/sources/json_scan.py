"""Scans of landed JSON payloads (S1-S5) with explicit nested schemas.

Payloads are read with a fixed ``StructType`` (no inference) either from
files (``spark.read.schema(...).json``) or from a string column
(``from_json``). Pages are exploded with their position so every item keeps
a stable ``(page key, item position)`` identity instead of a driver-side
list index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTIST = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
TRACK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("explicit", T.BooleanType()),
    T.StructField("artists", T.ArrayType(ARTIST)),
    T.StructField("album", T.StructType([T.StructField("name", T.StringType()),
                                         T.StructField("release_date", T.StringType())])),
    # link per service name
    T.StructField("external_urls", T.MapType(T.StringType(), T.StringType())),
])
PAGE_ITEM = T.StructType([
    T.StructField("added_at", T.StringType()),
    T.StructField("added_by", T.StructType([T.StructField("id", T.StringType())])),
    T.StructField("item", TRACK),
    T.StructField("track", TRACK),
])
PAGE = T.StructType([
    T.StructField("total", T.IntegerType()),
    T.StructField("next", T.StringType()),
    T.StructField("items", T.ArrayType(PAGE_ITEM)),
])
HEADER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("owner", T.StructType([T.StructField("display_name", T.StringType())])),
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))),
    T.StructField("followers", T.StructType([T.StructField("total", T.LongType())])),
])
ARTIST_PAGE = T.StructType([
    T.StructField("artists", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("genres", T.ArrayType(T.StringType()))]))),
])
# --- fixed values that must equal the analysed program's -----------------
# The nine feature fields of a feature record, in record order.
FEATURE_NAMES = ["danceability", "energy", "loudness", "speechiness", "acousticness",
                 "instrumentalness", "liveness", "valence", "tempo"]
# Envelope keys tried in this order when a feature payload is an object.
ENVELOPE_KEYS = ("content", "data", "audioFeatures")
# ---------------------------------------------------------------------------
FEATURE_RECORD = T.StructType([T.StructField("href", T.StringType())]
                              + [T.StructField(f, T.DoubleType()) for f in FEATURE_NAMES])


def read_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """Read landed JSON files with a fixed schema (a missing path raises)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def header_scan(df: DataFrame) -> DataFrame:
    """The five header fields only."""
    return df.select("name", "owner", "description", "images", "followers")


def page_items(pages: DataFrame, page_keys=("page_no",), items: str = "items") -> DataFrame:
    """S2 + F1: explode pages with position, unwrap ``item`` (else ``track``),
    keep only valid tracks, attach the wrapper's ``added_at`` / ``added_by``."""
    keys = list(page_keys)
    ex = pages.select(*keys, F.posexplode_outer(items).alias("item_pos", "w"))
    # an empty object counts as missing, like null
    some = F.greatest(*[F.col(f"w.item.{f}").isNotNull() for f in TRACK.fieldNames()])
    track = F.when(some, F.col("w.item")).otherwise(F.col("w.track"))
    ex = ex.select(*keys, "item_pos", track.alias("t"),
                   F.coalesce(F.col("w.added_at"), F.lit("")).alias("added_at"),
                   F.coalesce(F.col("w.added_by.id"), F.lit("")).alias("added_by"))
    valid = F.col("t").isNotNull() & (F.col("t.type") == "track") & F.col("t.id").isNotNull() & (F.col("t.id") != "")
    return ex.filter(valid)


def artist_requests(items: DataFrame, artist_id: str = "artist_id", order_col: str = "pos", size: int = 50) -> DataFrame:
    """S3: distinct artist ids in first-seen order, in requests of ``size``; missing and empty ids are not asked for."""
    from featurelens.operators.positions import batch_numbers

    firsts = items.filter(F.coalesce(F.col(artist_id), F.lit("")) != "").groupBy(artist_id).agg(F.min(order_col).alias("first_pos"))
    return batch_numbers(firsts, "first_pos", size, tiebreak=[artist_id])


def artist_genres(artist_pages: DataFrame, page_col: str | None = None) -> DataFrame:
    """S3: (artist_id, genres) from artist pages; null artists dropped,
    missing genres -> []. One row per artist id: its last record on the last
    page (``page_col``; without it the records of one page are meant)."""
    page = F.col(page_col) if page_col else F.lit(0)
    a = artist_pages.select(page.alias("_page"), F.posexplode("artists").alias("_pos", "a")).filter(F.col("a").isNotNull())
    genres = F.coalesce(F.col("a.genres"), F.array().cast("array<string>"))
    last = F.max_by(genres, F.struct("_page", "_pos")).alias("genres")
    return a.groupBy(F.col("a.id").alias("artist_id")).agg(last)


def read_artist_genres(spark: SparkSession, path: str) -> DataFrame:
    """S3 from landed artist pages; an absent source gives an empty lookup
    with the right schema (genres then default to [] downstream), not an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hp = jvm.org.apache.hadoop.fs.Path(path)
    if not hp.getFileSystem(conf).exists(hp):
        return spark.createDataFrame([], "artist_id string, genres array<string>")
    pages = read_json(spark, path, ARTIST_PAGE).withColumn("_file", F.input_file_name())  # landed names sort by page
    return artist_genres(pages, "_file")


def unwrap_envelope(payload, item_type: str, keys=ENVELOPE_KEYS) -> Column:
    """A JSON list as is; an object's first non-empty list among ``keys``; else []."""
    p = F.col(payload) if isinstance(payload, str) else payload
    arr_t = f"array<{item_type}>"
    empty = F.array().cast(arr_t)
    env_t = "struct<" + ",".join(f"`{k}`:{arr_t}" for k in keys) + ">"
    env = F.from_json(p, env_t)
    parts = [F.when(F.size(env[k]) > 0, env[k]) for k in keys]
    from_obj = F.coalesce(*parts, empty)
    is_list = F.ltrim(p).startswith("[")
    return F.when(is_list, F.coalesce(F.from_json(p, arr_t), empty)).otherwise(from_obj)


def normalise_features(rec, requested_id, names=FEATURE_NAMES, null_ints=("key", "mode", "time_signature")) -> list:
    """Requested id, the feature fields, and the integer fields forced NULL."""
    r = F.col(rec) if isinstance(rec, str) else rec
    return ([requested_id.alias("id")] + [r[n].alias(n) for n in names]
            + [F.lit(None).cast("int").alias(n) for n in null_ints])


def resolve_feature_batches(requested: DataFrame, responses: DataFrame, id_col: str = "id",
                            order_col: str = "pos", batch: int = 10, payload: str = "payload",
                            link_pattern: str | None = None) -> DataFrame:
    """S4 end to end: requested ids are cut into batches of ``batch`` in
    ``order_col`` order (W2); each batch's response ``payload`` (a JSON string
    in any envelope, P3) is exploded with positions; every requested id takes
    the record whose link carries it, else the record at its position, else
    nothing (J3); records are normalised (P4). ``responses`` has
    ``batch_no`` and ``payload``. One row per requested id."""
    from featurelens.functions.columns import ITEM_LINK_PATTERN, link_id
    from featurelens.operators.positions import batch_numbers, resolve_by_link_or_position

    link_pattern = link_pattern or ITEM_LINK_PATTERN
    req = batch_numbers(requested, order_col, batch).select(id_col, "batch_no", "pos_in_batch")
    item_type = FEATURE_RECORD.simpleString()
    recs = responses.select("batch_no", F.posexplode(unwrap_envelope(payload, item_type)).alias("resp_pos", "rec"))
    recs = recs.select("batch_no", "resp_pos", link_id(F.col("rec.href"), link_pattern).alias("link_id"),
                       F.col("rec").alias("payload"))
    res = resolve_by_link_or_position(req, recs, req_id=id_col)
    return res.select(*normalise_features(F.col("payload"), F.col(id_col)), "batch_no", "pos_in_batch", "matched_by")
