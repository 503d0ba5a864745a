"""SQL twins for the ingestion / parsing / lookup queries."""

from __future__ import annotations

from featurelens.plans.ingest_queries import ARTIST_PAGE_SIZE, BATCH, LINK_BASE, PAGE_SIZE
from featurelens.plans.oracle import R, SQL, WITH_ITEMS
from featurelens.sources.json_scan import FEATURE_NAMES

MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
PAGED = f"c AS (SELECT *, CAST(floor(turn / {PAGE_SIZE}) AS BIGINT) AS page_no FROM conversations)"

SQL["explode_items"] = f"""WITH {PAGED},
r AS (SELECT conv_id, page_no, turn, role, text,
             CAST(row_number() OVER (PARTITION BY conv_id, page_no ORDER BY turn) - 1 AS INTEGER) AS item_pos
      FROM c)
SELECT conv_id, page_no, item_pos,
       CAST(row_number() OVER (PARTITION BY conv_id, page_no ORDER BY item_pos) - 1 AS INTEGER) AS pos,
       CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text AS name, role AS added_by,
       CAST(role = 'assistant' AS INTEGER) AS explicit
FROM r WHERE role <> 'system'"""

SQL["first_of_array"] = f"""WITH {PAGED},
a AS (SELECT conv_id, page_no,
             list({{'id': CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 'name': role}} ORDER BY turn) AS a
      FROM c GROUP BY conv_id, page_no)
SELECT conv_id, page_no, coalesce(a[1].id, '') AS artist_id, coalesce(a[1].name, '') AS artist,
       coalesce(array_to_string(list_transform(a, lambda x: x.name), ', '), '') AS all_artists,
       coalesce(a[1].name, 'Unknown') AS primary_genre,
       CASE WHEN len(a) > 0 THEN array_to_string(list_transform(a[1:3], lambda x: x.name), ' | ')
            ELSE 'Unknown' END AS genres
FROM a"""

_ID = "regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1)"
_LANG = "regexp_extract(coalesce(url, ''), '/([a-z]{2})/[0-9]+', 1)"
SQL["id_from_url"] = f"""SELECT page_id,
       CASE WHEN starts_with(url, 'page:') THEN string_split(url, ':')[-1]
            WHEN {_ID} <> '' THEN {_ID} ELSE trim(url) END AS parsed_id,
       CASE WHEN {_LANG} <> '' THEN {_LANG} END AS lang
FROM pages"""

_T = "STRUCT(k BIGINT)[]"


def _env(key):
    v = f"CAST(json_extract(payload, '$.{key}') AS {_T})"
    return f"CASE WHEN len({v}) > 0 THEN {v} END"


SQL["json_props"] = f"""WITH p AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN '[' || props || ']'
                                   WHEN 'view' THEN '{{"content": [' || props || ']}}'
                                   WHEN 'purchase' THEN '{{"data": [' || props || ']}}'
                                   WHEN 'signup' THEN '{{"audioFeatures": [' || props || ']}}'
                                   ELSE '{{"content": [], "data": [' || props || ']}}' END AS payload
  FROM events),
u AS (SELECT event_id,
             CASE WHEN ltrim(payload) LIKE '[%' THEN coalesce(CAST(CAST(payload AS JSON) AS {_T}), CAST([] AS {_T}))
                  ELSE coalesce({_env('content')}, {_env('data')}, {_env('audioFeatures')}, CAST([] AS {_T})) END AS items
      FROM p),
x AS (SELECT event_id, items, unnest(range(len(items))) AS i FROM u)
SELECT event_id, CAST(i AS INTEGER) AS elem_pos, items[i + 1].k AS k,
       NULL::INTEGER AS key, NULL::INTEGER AS mode, NULL::INTEGER AS time_signature
FROM x"""

BATCHED = f"""req AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events),
req2 AS (SELECT event_id, event_type, value, CAST(event_id AS VARCHAR) AS id, CAST(rn // {BATCH} AS BIGINT) AS batch_no,
                CAST(rn % {BATCH} AS INTEGER) AS pos_in_batch FROM req)"""

SQL["batch_number"] = f"""WITH {BATCHED}
SELECT event_id, batch_no, pos_in_batch FROM req2"""

SQL["positional_fallback"] = f"""WITH {BATCHED},
resp AS (SELECT batch_no,
                CAST(row_number() OVER (PARTITION BY batch_no ORDER BY event_id DESC) - 1 AS INTEGER) AS resp_pos,
                CASE WHEN event_type <> 'error'
                     THEN nullif(regexp_extract('{LINK_BASE}' || CAST(event_id AS VARCHAR), 'track/([A-Za-z0-9]+)', 1), '')
                END AS link_id,
                value AS payload
         FROM req2 WHERE NOT (event_type = 'view' AND value < 5.0)),
bl AS (SELECT batch_no, link_id, payload FROM (
         SELECT *, row_number() OVER (PARTITION BY batch_no, link_id ORDER BY resp_pos DESC) AS k
         FROM resp WHERE link_id IS NOT NULL) WHERE k = 1)
SELECT r.event_id, r.batch_no, r.pos_in_batch,
       CASE WHEN bl.batch_no IS NOT NULL THEN bl.payload ELSE bp.payload END AS payload,
       CASE WHEN bl.batch_no IS NOT NULL THEN 'link' WHEN bp.batch_no IS NOT NULL THEN 'position' ELSE 'none' END AS matched_by
FROM req2 r
LEFT JOIN bl ON r.batch_no = bl.batch_no AND r.id = bl.link_id
LEFT JOIN resp bp ON r.batch_no = bp.batch_no AND r.pos_in_batch = bp.resp_pos"""

SQL["fallback_union"] = """SELECT event_id, value, source FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY priority ASC, event_id DESC) AS rn FROM (
    SELECT event_id, value, 'batch' AS source, 0 AS priority FROM events WHERE event_type <> 'error'
    UNION ALL
    SELECT event_id, value, 'single' AS source, 1 AS priority FROM events WHERE event_type IN ('error', 'click')))
WHERE rn = 1"""

SQL["feature_left_join"] = """WITH lab AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC) AS rn FROM labels) WHERE rn = 1)
SELECT d.doc_id, coalesce(d.lang, '') AS lang, coalesce(d.source, '') AS source, l.quality, l.toxic,
       CAST(l.quality IS NOT NULL AS INTEGER) AS has_features
FROM documents d LEFT JOIN lab l ON d.doc_id = l.doc_id"""

SQL["feature_coverage"] = f"""SELECT count(*) AS total, count(l.quality) AS with_features,
       {R('count(l.quality) / count(*)', 6)} AS coverage
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

SQL["genre_left_join"] = """WITH g AS (SELECT n_regionkey AS artist_id, list(n_name ORDER BY n_nationkey) AS genres
           FROM nation GROUP BY n_regionkey),
cu AS (SELECT c.c_custkey, n.n_regionkey AS artist_id FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT cu.c_custkey, cu.artist_id, coalesce(g.genres[1], 'Unknown') AS primary_genre,
       CASE WHEN len(coalesce(g.genres, [])) > 0 THEN array_to_string(g.genres[1:3], ' | ') ELSE 'Unknown' END AS genres
FROM cu LEFT JOIN g ON cu.artist_id = g.artist_id"""

SQL["date_parts"] = f"""WITH o AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS added_at,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m') END AS release_date
  FROM orders),
t AS (SELECT *, try_strptime(added_at, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM o)
SELECT o_orderkey, TRY_CAST(substring(release_date, 1, 4) AS INTEGER) AS release_year,
       CAST(year(ts) AS INTEGER) AS added_year, CAST(month(ts) AS INTEGER) AS added_month,
       ({MONTHS})[month(ts)] AS month_name, coalesce(strftime(ts, '%Y-%m-%d'), '?') AS added_date
FROM t"""

SQL["derived_units"] = f"""{WITH_ITEMS},
f AS (SELECT count(price) > 0 AS has_tempo FROM order_items)
SELECT oi.row_id, CAST(coalesce(o.o_orderstatus = 'F', false) AS INTEGER) AS explicit,
       {R('oi.total / 60000', 2)} AS duration_min,
       CASE WHEN f.has_tempo THEN {R('oi.price', 1)} ELSE 0.0::DOUBLE END AS bpm,
       {R('coalesce(oi.price, 0.0::DOUBLE)', 3)} AS price_disp, coalesce(oi.name, '?') AS name_disp
FROM order_items oi JOIN orders o ON oi.row_id = o.o_orderkey, f"""

SQL["safe_name"] = r"""SELECT p_partkey,
       trim(substring(regexp_replace(p_name || '!?/' || p_brand || ' (' || p_type || ') *#',
                                     '[^\p{L}\p{N} _-]', '', 'g'), 1, 40)) AS safe
FROM part"""

SQL["month_names"] = f"""SELECT month, n, ({MONTHS})[month] AS month_name FROM (
  SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1)"""

SQL["artist_batches"] = f"""WITH f AS (SELECT p_name AS artist_id, min(p_partkey) AS first_pos FROM part WHERE coalesce(p_name, '') <> '' GROUP BY p_name),
r AS (SELECT *, row_number() OVER (ORDER BY first_pos, artist_id) - 1 AS rn FROM f)
SELECT artist_id, first_pos, CAST(rn // {ARTIST_PAGE_SIZE} AS BIGINT) AS batch_no, CAST(rn % {ARTIST_PAGE_SIZE} AS INTEGER) AS pos_in_batch FROM r"""

LAST_GENRES = """lg AS (SELECT p_brand AS artist_id, CASE WHEN p_size % 5 <> 0 THEN string_split(p_type, ' ') ELSE [] END AS genres FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS k FROM part) WHERE k = 1)"""
_PRIMARY = "coalesce(genres[1], 'Unknown')"
_GENRES = "CASE WHEN len(coalesce(genres, [])) > 0 THEN array_to_string(genres[1:3], ' | ') ELSE 'Unknown' END"

SQL["artist_genres"] = f"""WITH {LAST_GENRES}
SELECT artist_id, CAST(len(genres) AS INTEGER) AS n_genres, {_PRIMARY} AS primary_genre, {_GENRES} AS genres FROM lg"""

_FEATURES = ", ".join(f"payload * {i + 1} AS {f}" for i, f in enumerate(FEATURE_NAMES))
SQL["feature_batches"] = f"""WITH pf AS ({SQL['positional_fallback']})
SELECT CAST(event_id AS VARCHAR) AS id, {_FEATURES}, NULL::INTEGER AS key, NULL::INTEGER AS mode, NULL::INTEGER AS time_signature,
       batch_no, pos_in_batch, matched_by FROM pf"""

SQL["assemble_tracks"] = f"""WITH {PAGED}, {LAST_GENRES},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, page_no ORDER BY turn) - 1 AS INTEGER) AS item_pos FROM c),
t AS (SELECT *, CASE WHEN turn % 4 <> 3 THEN CASE WHEN role = 'user' THEN length(text) / 7 ELSE length(text)::DOUBLE END END AS tp,
             CASE WHEN turn % 2 = 0 THEN '2024-03-0' || CAST(turn % 7 + 1 AS VARCHAR) || 'T10:00:00Z' ELSE '' END AS added_at
      FROM r WHERE role <> 'system'),
h AS (SELECT count(tp) > 0 AS has_tempo FROM t),
x AS (SELECT t.*, lg.genres AS g, try_strptime(added_at, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM t LEFT JOIN lg
      ON t.role = CASE WHEN lg.artist_id = 'Brand#11' THEN 'user' ELSE lg.artist_id END)
SELECT conv_id, page_no, item_pos, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text AS name,
       role AS artist, role AS all_artists, role AS artist_id, role AS album, NULL::INTEGER AS release_year,
       length(text)::BIGINT AS duration_ms, CAST(role = 'assistant' AS INTEGER) AS explicit,
       'https://chat.example.org/c/' || CAST(conv_id AS VARCHAR) AS source_url, added_at, role AS added_by,
       coalesce(g[1], 'Unknown') AS primary_genre,
       CASE WHEN len(coalesce(g, [])) > 0 THEN array_to_string(g[1:3], ' | ') ELSE 'Unknown' END AS genres,
       {R('tp', 6)} AS tempo, {R('length(text) / 60000', 2)} AS duration_min,
       CASE WHEN h.has_tempo THEN {R('tp', 1)} ELSE 0.0::DOUBLE END AS bpm,
       CAST(year(ts) AS INTEGER) AS added_year, CAST(month(ts) AS INTEGER) AS added_month,
       ({MONTHS})[month(ts)] AS month_name, coalesce(strftime(ts, '%Y-%m-%d'), '?') AS added_date
FROM x, h"""
