"""SQL twins for the explorer queries."""

from __future__ import annotations

from featurelens.operators.explore import ACCENT, ACCENT_RED, CLUSTER_PALETTE
from featurelens.plans.explore_queries import DOMAIN_COLUMNS, FLAGS, RANGES, SEARCH, SKETCH_PROBS, TOP_N
from featurelens.plans.oracle import D, R, SQL, TIMELINE, WITH_ITEMS

PAL = "[" + ", ".join(f"'{p}'" for p in CLUSTER_PALETTE) + "]"


def _cond():
    parts = []
    for c, (lo, hi) in RANGES.items():
        v = f"coalesce(CAST({c} AS DOUBLE), 0.0::DOUBLE)"
        parts.append(f"(isnan({v}) OR ({v} >= {D(lo)} AND {v} <= {D(hi)}))")
    flags = ", ".join(f"'{f}'" for f in FLAGS)
    parts.append(f"coalesce(l_returnflag IN ({flags}), false)")
    return " AND ".join(parts)


SQL["range_filter"] = f"""WITH li AS (SELECT *, year(l_shipdate) AS ship_year FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST({_cond()} AS INTEGER) AS visible,
       CAST({_cond()} AND coalesce(l_linestatus = 'F', false) AS INTEGER) AS visible_outliers
FROM li"""

SQL["filter_domain"] = " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, coalesce({R(f'min({c})', 2)}, 0.0::DOUBLE) AS lo, "
     f"coalesce({R(f'max({c})', 2)}, 1.0::DOUBLE) AS hi FROM lineitem" for c in DOMAIN_COLUMNS]
    + ["SELECT 'ship_year' AS feature, CAST(coalesce(min(year(l_shipdate)), 1900) AS DOUBLE) AS lo, "
       "CAST(coalesce(max(year(l_shipdate)), 2025) AS DOUBLE) AS hi FROM lineitem"])

CATS = """ca AS (SELECT cluster, CAST(row_number() OVER (ORDER BY cluster) - 1 AS BIGINT) AS cluster_idx
       FROM (SELECT DISTINCT cluster FROM order_items WHERE cluster IS NOT NULL))"""

SQL["palette_index"] = f"""{WITH_ITEMS},
v AS (SELECT *, {R('coalesce(CAST(price AS DOUBLE), 0.0::DOUBLE)', 4)} AS pv FROM order_items),
b AS (SELECT min(pv) AS lo, max(pv) AS hi FROM v),
{CATS},
ar AS (SELECT artist, CAST(row_number() OVER (ORDER BY first_pos) - 1 AS BIGINT) AS artist_idx
       FROM (SELECT artist, min(pos) AS first_pos FROM order_items GROUP BY artist))
SELECT v.row_id, CAST(floor((v.pv - b.lo) / (b.hi - b.lo + 1e-9) * 255) AS INTEGER) AS num_idx,
       ca.cluster_idx, ({PAL})[ca.cluster_idx % 20 + 1] AS cluster_color,
       ar.artist_idx, ({PAL})[ar.artist_idx % 20 + 1] AS artist_color,
       CASE WHEN v.explicit = 1 THEN '{ACCENT_RED}' ELSE '{ACCENT}' END AS flag_color
FROM v CROSS JOIN b LEFT JOIN ca ON v.cluster = ca.cluster LEFT JOIN ar ON v.artist = ar.artist"""

SQL["point_projection"] = f"""{WITH_ITEMS},
{CATS}
SELECT o.row_id, {R('coalesce(CAST(o.qty AS DOUBLE), 0.0::DOUBLE)', 4)} AS x,
       {R('coalesce(CAST(o.price AS DOUBLE), 0.0::DOUBLE)', 4)} AS y, o.name, o.artist, o.cluster,
       {R('coalesce(o.disc, 0.0::DOUBLE)', 2)} AS energy, {R('coalesce(o.price, 0.0::DOUBLE)', 1)} AS tempo,
       {R('coalesce(o.tax, 0.0::DOUBLE)', 2)} AS valence, ({PAL})[ca.cluster_idx % 20 + 1] AS color
FROM order_items o LEFT JOIN ca ON o.cluster = ca.cluster"""

for _name, _dir in (("top_n", "DESC"), ("bottom_n", "ASC")):
    SQL[_name] = f"""{WITH_ITEMS}
SELECT row_id, name, artist, {R('price', 3)} AS price, total FROM order_items
ORDER BY price {_dir} NULLS LAST, pos ASC LIMIT {TOP_N}"""

SQL["name_search"] = f"""SELECT p_partkey, p_name, p_brand, p_retailprice FROM part
WHERE coalesce(regexp_matches(lower(p_name), '{SEARCH.strip().lower()}'), false)
ORDER BY p_partkey LIMIT 1"""

_QX, _QY = "coalesce(sx, 0.0::DOUBLE)", "coalesce(sy, 0.0::DOUBLE)"
SQL["mood_quadrant"] = f"""{TIMELINE},
b AS (SELECT min(disc) AS ld, max(disc) AS hd, min(qty) AS lq, max(qty) AS hq FROM tl),
s AS (SELECT row_id, year, (disc - ld) / (hd - ld) AS sx, (qty - lq) / (hq - lq) AS sy FROM tl, b)
SELECT row_id, year, {R(_QX, 6)} AS x, {R(_QY, 6)} AS y,
       CASE WHEN {_QX} >= 0.5 AND {_QY} >= 0.5 THEN 'Happy & Intense'
            WHEN {_QX} < 0.5 AND {_QY} >= 0.5 THEN 'Dark & Intense'
            WHEN {_QX} >= 0.5 AND {_QY} < 0.5 THEN 'Happy & Calm'
            ELSE 'Dark & Calm' END AS quadrant
FROM s"""

_COUNTS = " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS feature, count({c}) AS n FROM lineitem GROUP BY l_returnflag" for c in DOMAIN_COLUMNS)
SQL["quantile_sketch"] = f"""SELECT l_returnflag, feature, n, p, true AS within_bound
FROM ({_COUNTS}), (SELECT unnest([{', '.join(D(p) for p in SKETCH_PROBS)}]) AS p) WHERE n > 0"""
