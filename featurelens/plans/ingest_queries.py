"""Catalogue bindings for ingestion, scalar parsing and lookup joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from featurelens.functions.columns import collection_id, link_id, month_short, rnd, safe_name
from featurelens.operators import positions, tracks
from featurelens.plans.catalogue import query
from featurelens.sources import json_scan
from featurelens.sources.tables import load, order_items

PAGE_SIZE = 100           # items per landed page
BATCH = 10                # ids per feature request
LINK_BASE = "https://api.example.org/v1/track/"


def withheld():
    """Responses missing from a batch: views with a small value."""
    return (F.col("event_type") == "view") & (F.col("value") < 5.0)


def conversation_pages(spark, d):
    """Conversations landed as JSON pages of at most PAGE_SIZE turns, one
    document per (conv_id, page); system turns are non-track items, user
    turns wrap the track in ``item`` and the others in ``track``."""
    c = load(spark, d, "conversations")
    paged = c.withColumn("page_no", F.floor(F.col("turn") / PAGE_SIZE).cast("long"))
    docs = (paged.groupBy("conv_id", "page_no")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "conv_id", "role", "text"))).alias("ts"),
                 F.count(F.lit(1)).alias("n")))

    def wrap(x):
        track = F.struct(
            F.concat_ws("-", x["conv_id"].cast("string"), x["turn"].cast("string")).alias("id"),
            x["text"].alias("name"),
            F.when(x["role"] == "system", F.lit("episode")).otherwise(F.lit("track")).alias("type"),
            F.length(x["text"]).cast("long").alias("duration_ms"),
            (x["role"] == "assistant").alias("explicit"),
            F.array(F.struct(x["role"].alias("id"), x["role"].alias("name"))).alias("artists"),
            F.struct(x["role"].alias("name"), F.lit("").alias("release_date")).alias("album"),
            F.create_map(F.lit("app"), F.lit("app:other"), F.lit("web"),
                         F.concat(F.lit("https://chat.example.org/c/"), x["conv_id"].cast("string"))).alias("external_urls"))
        empty = F.lit(None).cast(json_scan.TRACK)
        empty = F.struct(*[empty[f].alias(f) for f in json_scan.TRACK.fieldNames()])
        added = F.when(x["turn"] % 2 == 0, F.concat(F.lit("2024-03-0"), (x["turn"] % 7 + 1).cast("string"),
                                                    F.lit("T10:00:00Z"))).otherwise(F.lit(""))
        return F.struct(added.alias("added_at"), F.struct(x["role"].alias("id")).alias("added_by"),
                        # what is not a user turn has an empty wrapper, or none
                        F.when(x["role"] == "user", track).when(x["turn"] % 3 == 0, empty).alias("item"),
                        F.when(x["role"] != "user", track).alias("track"))

    body = F.struct(F.col("n").cast("int").alias("total"), F.lit(None).cast("string").alias("next"),
                    F.transform("ts", wrap).alias("items"))
    return docs.select("conv_id", "page_no", F.to_json(body).alias("payload"))


@query("explode_items")
def q_explode_items(spark, d):
    docs = conversation_pages(spark, d)
    pages = docs.select("conv_id", "page_no", F.from_json("payload", json_scan.PAGE).alias("p")) \
        .select("conv_id", "page_no", "p.items")
    items = json_scan.page_items(pages, ["conv_id", "page_no"])
    w = Window.partitionBy("conv_id", "page_no").orderBy("item_pos")
    return items.select("conv_id", "page_no", "item_pos", (F.row_number().over(w) - 1).alias("pos"),
                        F.col("t.id").alias("id"), F.col("t.name").alias("name"), "added_by",
                        tracks.flag_int(F.col("t.explicit")).alias("explicit"))


ARTIST_PAGE_SIZE = 50


def artist_pages(spark, d):
    """Artist records landed as JSON pages of ARTIST_PAGE_SIZE in part order; an
    artist (a brand) comes again on many pages, some records have no genres."""
    p = load(spark, d, "part").withColumn("page_no", F.floor((F.col("p_partkey") - 1) / ARTIST_PAGE_SIZE).cast("long"))
    genres = F.when(F.col("p_size") % 5 != 0, F.split("p_type", " "))
    rec = F.struct("p_partkey", F.col("p_brand").alias("id"), genres.alias("genres"))
    pages = p.groupBy("page_no").agg(F.sort_array(F.collect_list(rec)).alias("r"))  # one page a row
    body = F.struct(F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["genres"].alias("genres"))).alias("artists"))
    landed = pages.select("page_no", F.to_json(body).alias("payload"))
    return landed.select("page_no", F.from_json("payload", json_scan.ARTIST_PAGE).alias("p")).select("page_no", "p.artists")


@query("artist_batches")
def q_artist_batches(spark, d):
    items = load(spark, d, "part").select(F.col("p_name").alias("artist_id"), F.col("p_partkey").alias("pos"))
    return json_scan.artist_requests(items, size=ARTIST_PAGE_SIZE)


@query("artist_genres")
def q_artist_genres(spark, d):
    found = json_scan.artist_genres(artist_pages(spark, d), "page_no")
    return found.select("artist_id", F.size("genres").alias("n_genres"), *tracks.genre_columns(F.col("genres")))


@query("feature_batches")
def q_feature_batches(spark, d):
    """Feature requests for events in batches; responses lack the withheld ones,
    come in reverse order and in a different envelope for every batch."""
    ev = load(spark, d, "events").select("event_id", "event_type", "value", F.col("event_id").cast("string").alias("id"))
    numbered = positions.batch_numbers(ev, "event_id", BATCH).filter(~withheld())
    href = F.when(F.col("event_type") != "error", F.concat(F.lit(LINK_BASE), "id"))
    values = [(F.col("value") * (i + 1)).alias(f) for i, f in enumerate(json_scan.FEATURE_NAMES)]
    rec = F.struct((-F.col("event_id")).alias("o"), F.struct(href.alias("href"), *values).alias("r"))
    lists = numbered.groupBy("batch_no").agg(F.transform(F.sort_array(F.collect_list(rec)), lambda x: x["r"]).alias("l"))
    body = F.to_json("l")
    kind = F.col("batch_no") % 3
    payload = (F.when(kind == 0, body).when(kind == 1, F.concat(F.lit('{"content": '), body, F.lit("}")))
               .otherwise(F.concat(F.lit('{"content": [], "data": '), body, F.lit("}"))))
    return json_scan.resolve_feature_batches(ev.select("id", F.col("event_id").alias("pos")), lists.select("batch_no", payload.alias("payload")))


@query("assemble_tracks")
def q_assemble_tracks(spark, d):
    """The track table from landed pages, features (two records for some ids,
    none for others) and artist genres."""
    pages = conversation_pages(spark, d).select("conv_id", "page_no", F.from_json("payload", json_scan.PAGE).alias("p"))
    items = json_scan.page_items(pages.select("conv_id", "page_no", "p.items"), ["conv_id", "page_no"])
    c = load(spark, d, "conversations").filter("turn % 4 <> 3")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    first = c.select(key.alias("id"), F.lit(0).alias("feature_pos"), F.length("text").cast("double").alias("tempo"))
    again = c.filter("role = 'user'").select(key.alias("id"), F.lit(1).alias("feature_pos"), (F.length("text") / 7).alias("tempo"))
    roles = json_scan.artist_genres(artist_pages(spark, d), "page_no").withColumn(
        "artist_id", F.when(F.col("artist_id") == "Brand#11", F.lit("user")).otherwise(F.col("artist_id")))
    out = tracks.assemble_tracks(items, first.unionByName(again), roles, ["tempo"], service="web")
    return out.drop("added_at_dt").withColumn("tempo", rnd("tempo", 6))


@query("first_of_array")
def q_first_of_array(spark, d):
    c = load(spark, d, "conversations").withColumn("page_no", F.floor(F.col("turn") / PAGE_SIZE).cast("long"))
    arr = (c.groupBy("conv_id", "page_no")
           .agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws("-", F.col("conv_id").cast("string"),
                                                                          F.col("turn").cast("string")).alias("id"),
                                                      F.col("role").alias("name")))).alias("a")))
    arr = arr.withColumn("a", F.transform("a", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))))
    return arr.select("conv_id", "page_no", *tracks.first_artist(F.col("a")),
                      *tracks.genre_columns(F.transform("a", lambda x: x["name"])))


@query("id_from_url")
def q_id_from_url(spark, d):
    p = load(spark, d, "pages")
    return p.select("page_id", collection_id("url", pattern=r"/[a-z]{2}/([0-9]+)", uri_prefix="page:").alias("parsed_id"),
                    link_id("url", pattern=r"/([a-z]{2})/[0-9]+").alias("lang"))


def _payloads(spark, d):
    e = load(spark, d, "events")
    p = F.col("props")
    payload = (F.when(F.col("event_type") == "click", F.concat(F.lit("["), p, F.lit("]")))
               .when(F.col("event_type") == "view", F.concat(F.lit('{"content": ['), p, F.lit("]}")))
               .when(F.col("event_type") == "purchase", F.concat(F.lit('{"data": ['), p, F.lit("]}")))
               .when(F.col("event_type") == "signup", F.concat(F.lit('{"audioFeatures": ['), p, F.lit("]}")))
               .otherwise(F.concat(F.lit('{"content": [], "data": ['), p, F.lit("]}"))))
    return e.select("event_id", payload.alias("payload"))


@query("json_props")
def q_json_props(spark, d):
    items = _payloads(spark, d).select("event_id", json_scan.unwrap_envelope("payload", "struct<k:bigint>").alias("items"))
    ex = items.select("event_id", F.posexplode("items").alias("elem_pos", "r"))
    return ex.select("event_id", "elem_pos", F.col("r.k").alias("k"),
                     *[F.lit(None).cast("int").alias(n) for n in ("key", "mode", "time_signature")])


@query("batch_number")
def q_batch_number(spark, d):
    return positions.batch_numbers(load(spark, d, "events").select("event_id"), "event_id", BATCH)


@query("positional_fallback")
def q_positional_fallback(spark, d):
    ev = positions.batch_numbers(load(spark, d, "events").select("event_id", "event_type", "value"), "event_id", BATCH)
    requests = ev.select("event_id", F.col("event_id").cast("string").alias("id"), "batch_no", "pos_in_batch")
    kept = ev.filter(~withheld())
    href = F.when(F.col("event_type") != "error", F.concat(F.lit(LINK_BASE), F.col("event_id").cast("string")))
    rw = Window.partitionBy("batch_no").orderBy(F.col("event_id").desc())
    responses = kept.select("batch_no", (F.row_number().over(rw) - 1).alias("resp_pos"),
                            link_id(href).alias("link_id"), F.col("value").alias("payload"))
    res = positions.resolve_by_link_or_position(requests, responses)
    return res.select("event_id", "batch_no", "pos_in_batch", "payload", "matched_by")


@query("fallback_union")
def q_fallback_union(spark, d):
    e = load(spark, d, "events")
    batch = e.filter(F.col("event_type") != "error").select("event_id", "value", F.lit("batch").alias("source"),
                                                             F.lit(0).alias("priority"))
    single = e.filter(F.col("event_type").isin("error", "click")).select(
        "event_id", "value", F.lit("single").alias("source"), F.lit(1).alias("priority"))
    u = batch.unionByName(single)
    return positions.dedupe_last(u, "event_id", "event_id", priority="priority").select("event_id", "value", "source")


@query("feature_left_join")
def q_feature_left_join(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "source")
    labels = positions.dedupe_last(load(spark, d, "labels"), "doc_id", "quality")
    j = docs.join(labels, "doc_id", "left")
    return j.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                    "quality", "toxic", F.col("quality").isNotNull().cast("int").alias("has_features"))


@query("feature_coverage")
def q_feature_coverage(spark, d):
    from featurelens.operators.profile import coverage
    docs = load(spark, d, "documents").select("doc_id")
    j = docs.join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return coverage(j, "quality")


@query("genre_left_join")
def q_genre_left_join(spark, d):
    nation = load(spark, d, "nation")
    # genre lookup: nation names per region (at most 25 rows, fixed)
    genres = (nation.groupBy(F.col("n_regionkey").alias("artist_id"))
              .agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("g"))
              .select("artist_id", F.transform("g", lambda x: x["n_name"]).alias("genres")))
    cust = load(spark, d, "customer").join(F.broadcast(nation.select("n_nationkey", "n_regionkey")),
                                           F.col("c_nationkey") == F.col("n_nationkey"), "left")
    j = cust.select("c_custkey", F.col("n_regionkey").alias("artist_id")).join(genres, "artist_id", "left")
    return j.select("c_custkey", "artist_id", *tracks.genre_columns(F.col("genres")))


def _dated_orders(spark, d):
    o = load(spark, d, "orders")
    added = F.when(F.col("o_orderstatus") == "P", F.lit("")) \
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rel = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return o.select("o_orderkey", added.alias("added_at"), rel.alias("release_date"))


@query("date_parts")
def q_date_parts(spark, d):
    o = _dated_orders(spark, d)
    enabled = tracks.any_nonempty(o, "added_at")
    cols = tracks.time_parts(F.col("added_at"), enabled)
    out = o.select("o_orderkey", tracks.release_year(F.col("release_date")), *cols)
    return out.drop("added_at_dt")


@query("derived_units")
def q_derived_units(spark, d):
    oi = order_items(spark, d)
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"),
                                        (F.col("o_orderstatus") == "F").alias("flag"))
    has_tempo = oi.filter(F.col("price").isNotNull()).limit(1).count() > 0
    j = oi.join(o, "row_id")
    return j.select("row_id", tracks.flag_int(F.col("flag")).alias("explicit"),
                    *tracks.derived_units(F.col("total"), F.col("price"), has_tempo),
                    rnd(F.coalesce(F.col("price"), F.lit(0.0)), 3).alias("price_disp"),
                    F.coalesce(F.col("name"), F.lit("?")).alias("name_disp"))


@query("safe_name")
def q_safe_name(spark, d):
    p = load(spark, d, "part")
    s = F.concat(F.col("p_name"), F.lit("!?/"), F.col("p_brand"), F.lit(" ("), F.col("p_type"), F.lit(") *#"))
    return p.select("p_partkey", safe_name(s).alias("safe"))


@query("month_names")
def q_month_names(spark, d):
    return load(spark, d, "orders").groupBy(F.month("o_orderdate").alias("month")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("month_name", month_short(F.col("month")))
