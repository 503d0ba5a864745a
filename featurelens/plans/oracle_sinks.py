"""SQL twins for the scan / stage / export queries (sinks have no other
oracle: the twin computes what should have been written)."""

from __future__ import annotations

from featurelens.plans.oracle import R, SQL, WITH_ITEMS
from featurelens.plans.sink_queries import REPORT_COLUMNS, REPORT_PROFILE, REPORT_TITLE

SQL["header_read"] = """SELECT c.c_name AS name, c.c_mktsegment AS description, n.n_name AS owner_name,
       CAST(1 AS INTEGER) AS n_images, CAST(floor(c.c_acctbal) AS BIGINT) AS followers
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"""

SQL["stage_roundtrip"] = f"""{WITH_ITEMS}
SELECT row_id, name, artist, {R('qty', 6)} AS qty, {R('price', 6)} AS price, cluster FROM order_items"""

SQL["csv_sink"] = f"""{WITH_ITEMS}
SELECT row_id, name, artist, album, {R('qty', 6)} AS qty, {R('price', 6)} AS price, cluster,
       {R('coalesce(qty, 0.0::DOUBLE)', 4)} AS x, {R('coalesce(price, 0.0::DOUBLE)', 4)} AS y
FROM order_items"""

SQL["point_export"] = SQL["point_projection"]


def _report():
    rule = "=" * 60
    head = [rule, f"  {REPORT_TITLE}", None, rule, "", "Collection : orders", "Owner      : ?", "",
            "── Summary " + "─" * 50]
    parts = []
    for i, line in enumerate(head):
        if line is None:
            parts.append(f"SELECT {i} AS ord, '  ' || (SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M') "
                         f"FROM orders) AS line")
        else:
            parts.append(f"SELECT {i} AS ord, '{line}' AS line")
    n0 = len(head)
    summary = [
        "printf('  Tracks          : %d', total_tracks)",
        "printf('  Unique artists  : %d', unique_artists)",
        "'  Year range      : ' || coalesce(CAST(year_min AS VARCHAR), 'N/A') || ' – ' || "
        "coalesce(CAST(year_max AS VARCHAR), 'N/A')",
        "'  Avg BPM         : ' || coalesce(printf('%.1f', avg_bpm), 'N/A')",
        "'  Avg energy      : ' || coalesce(printf('%.3f', avg_energy), 'N/A')",
        "'  Avg valence     : ' || coalesce(printf('%.3f', avg_valence), 'N/A')",
        "printf('  Total duration  : %.1f min', total_duration_min)",
        "printf('  Diversity score : %.4f', diversity)",
    ]
    for i, e in enumerate(summary):
        parts.append(f"SELECT {n0 + i} AS ord, {e} AS line FROM st")
    n1 = n0 + len(summary)
    parts.append(f"SELECT {n1} AS ord, '' AS line")
    parts.append(f"SELECT {n1 + 1} AS ord, '── Cluster profiles {'─' * 41}' AS line")
    fmt = "  %3d | n=%d" + "".join(f" | {c}=%.3f" for c in REPORT_COLUMNS)
    args = ", ".join(REPORT_COLUMNS)
    parts.append(f"SELECT CAST({n1 + 2} + row_number() OVER (ORDER BY cluster) - 1 AS INTEGER) AS ord, "
                 f"printf('{fmt}', cluster, cnt, {args}) AS line FROM prof")
    parts.append(f"SELECT CAST({n1 + 2} + (SELECT count(*) FROM prof) AS INTEGER) AS ord, '' AS line")
    return f"""{WITH_ITEMS},
e AS (SELECT CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv,
             vec_id FROM embeddings WHERE embedding IS NOT NULL),
dv AS (SELECT CASE WHEN (SELECT count(*) FROM e) < 2 THEN 0.0::DOUBLE ELSE {R('avg(1.0 - CASE WHEN a.nv * b.nv = 0 THEN 0.0 ELSE list_dot_product(a.v, b.v) / (a.nv * b.nv) END)', 4)} END AS diversity
       FROM e a JOIN e b ON a.vec_id < b.vec_id),
st AS (SELECT count(*) AS total_tracks, count(DISTINCT artist) AS unique_artists,
              min(release_year) AS year_min, max(release_year) AS year_max,
              {R('avg(price)', 1)} AS avg_bpm, {R('avg(disc)', 3)} AS avg_energy,
              {R('avg(explicit)', 3)} AS avg_valence, {R('coalesce(sum(lines), 0.0)', 1)} AS total_duration_min,
              (SELECT diversity FROM dv) AS diversity
       FROM order_items),
prof AS (SELECT cluster, count(*) AS cnt, {', '.join(f"{R(f'avg({c})', 3)} AS {c}_mean, {R(f'stddev_samp({c})', 3)} AS {c}_std" for c in REPORT_PROFILE)}
         FROM order_items GROUP BY cluster)
SELECT CAST(ord AS INTEGER) AS ord, line FROM ({' UNION ALL '.join(parts)})"""


SQL["report_lines"] = _report()
