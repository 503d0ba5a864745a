"""SQL twins of the catalogue queries, written for DuckDB.

The benchmark tables are pre-registered as views. Rounding uses the same
scaled half-even rule as ``functions.rnd`` so both engines produce the same
doubles; double literals go through strings so they parse to the same value.
"""

from __future__ import annotations

from featurelens.plans import catalogue as C
from featurelens.sources.tables import ITEM_FEATURES, ORDER_ITEMS_SQL

SQL: dict[str, str] = {}


def R(expr: str, n: int) -> str:
    r = f"round_even(({expr}), 0)" if n == 0 else f"(round_even(({expr}) * 1e{n}, 0) / 1e{n})"
    return f"(CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END)"


def D(v: float) -> str:
    return f"'{float(v)!r}'::DOUBLE"


def long_sql(src: str, cols, ids=(), name="feature", value="value") -> str:
    ids_sql = "".join(f"{i}, " for i in ids)
    return " UNION ALL ".join(
        f"SELECT {ids_sql}'{c}' AS {name}, CAST({c} AS DOUBLE) AS {value} FROM {src}" for c in cols)


def not_null(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


WITH_ITEMS = "WITH " + ORDER_ITEMS_SQL.strip()
CLEAN = f"clean AS (SELECT * FROM order_items WHERE {not_null(ITEM_FEATURES)})"
TIMELINE = f"""{WITH_ITEMS},
{CLEAN},
flag AS (SELECT count(added_year) > 0
                AND count(*) FILTER (WHERE added_year IS NULL OR added_year <> 0) > 0 AS has_added FROM clean),
tl AS (SELECT * FROM (
         SELECT c.*, CAST(CASE WHEN f.has_added THEN (CASE WHEN c.added_year = 0 THEN c.release_year
                                                        ELSE c.added_year END)
                               ELSE c.release_year END AS INTEGER) AS year
         FROM clean c, flag f) WHERE year IS NOT NULL)"""


def _sql(name):
    def deco(fn):
        SQL[name] = fn()
        return fn
    return deco


@_sql("yearly_trend")
def _():
    return f"""{TIMELINE},
long AS ({long_sql('tl', C.TREND_FEATURES, ids=['year'])}),
g AS (SELECT year, feature, avg(value) AS m, stddev_samp(value) AS s, count(*) AS cnt,
             quantile_cont(value, 0.5) AS med
      FROM long WHERE value IS NOT NULL GROUP BY year, feature HAVING count(*) >= 2),
g2 AS (SELECT *, count(*) OVER (PARTITION BY feature) AS ny FROM g)
SELECT year, feature, {R('m', 3)} AS mean, {R('med', 6)} AS median, {R('coalesce(s, 0)', 6)} AS std,
       cnt AS count,
       {R(f"greatest(0.0::DOUBLE, {R('m', 3)} - coalesce(s, 0))", 6)} AS band_lo,
       {R(f"least(1.0::DOUBLE, {R('m', 3)} + coalesce(s, 0))", 6)} AS band_hi
FROM g2 WHERE ny >= 2"""


@_sql("yearly_tempo_band")
def _():
    s = "coalesce(stddev_samp(total), 0)"
    return f"""{TIMELINE}
SELECT year, {R('avg(total)', 1)} AS mean, {R(f'avg(total) - {s}', 1)} AS lo,
       {R(f'avg(total) + {s}', 1)} AS hi, count(*) AS count
FROM tl WHERE total IS NOT NULL GROUP BY year HAVING count(*) >= 2"""


@_sql("heatmap_long")
def _():
    return f"""{TIMELINE},
long AS ({long_sql('tl', C.HEAT_FEATURES, ids=['year'])})
SELECT year, feature, {R('avg(value)', 3)} AS mean FROM long GROUP BY year, feature"""


@_sql("recent_vs_early")
def _():
    d = "(recent - early)"
    return f"""{TIMELINE},
long AS ({long_sql('tl', C.HEAT_FEATURES, ids=['year'])}),
b AS (SELECT min(year) AS ymin, max(year) AS ymax FROM tl),
a AS (SELECT feature, avg(value) FILTER (WHERE year >= ymax - 2) AS recent,
             avg(value) FILTER (WHERE year <= ymin + 2) AS early
      FROM long, b GROUP BY feature)
SELECT feature, {R('recent', 6)} AS recent, {R('early', 6)} AS early, {R(d, 6)} AS diff,
       CASE WHEN {d} IS NULL THEN 'N/A'
            ELSE (CASE WHEN {d} > 0.02 THEN '↑' WHEN {d} < -0.02 THEN '↓' ELSE '→' END)
                 || ' ' || printf('%.2f', {R(f'abs({d})', 2)}) END AS trend
FROM a"""


SQL["count_by_year"] = f"""{WITH_ITEMS}
SELECT added_year AS year, count(*) AS n FROM order_items WHERE added_year IS NOT NULL GROUP BY added_year"""

SQL["count_by_month"] = f"""{WITH_ITEMS}
SELECT added_month AS month, count(*) AS n FROM order_items WHERE added_month IS NOT NULL GROUP BY added_month"""

SQL["most_active_year"] = f"""{TIMELINE}
SELECT year, n FROM (SELECT year, count(*) AS n FROM tl GROUP BY year) ORDER BY n DESC, year ASC LIMIT 1"""

SQL["collection_stats"] = f"""{WITH_ITEMS}
SELECT count(*) AS total_tracks, count(DISTINCT artist) AS unique_artists,
       count(DISTINCT album) AS unique_albums, min(release_year) AS year_min, max(release_year) AS year_max,
       {R('avg(price)', 1)} AS avg_bpm, {R('avg(disc)', 3)} AS avg_energy,
       {R('avg(tax)', 3)} AS avg_danceability, {R('avg(explicit)', 3)} AS avg_valence,
       {R('coalesce(sum(lines), 0.0)', 1)} AS total_duration_min
FROM order_items"""

SQL["describe_long"] = f"""WITH long AS ({long_sql('lineitem', C.DESCRIBE_COLUMNS)})
SELECT feature, count(value) AS count, {R('avg(value)', 3)} AS mean, {R('stddev_samp(value)', 3)} AS std,
       {R('min(value)', 3)} AS min, {R('quantile_cont(value, 0.25)', 3)} AS p25,
       {R('quantile_cont(value, 0.5)', 3)} AS p50, {R('quantile_cont(value, 0.75)', 3)} AS p75,
       {R('max(value)', 3)} AS max
FROM long GROUP BY feature"""

_PROFILE = ["qty", "price", "disc", "tax", "total"]
SQL["cluster_profile"] = f"""{WITH_ITEMS}
SELECT cluster, {', '.join(f"{R(f'avg({c})', 3)} AS {c}_mean, {R(f'stddev_samp({c})', 3)} AS {c}_std" for c in _PROFILE)},
       count(*) AS count
FROM order_items GROUP BY cluster"""

SQL["cluster_table"] = f"""{WITH_ITEMS},
oi AS (SELECT * REPLACE (CASE WHEN cluster = 4 THEN -1 ELSE cluster END AS cluster) FROM order_items)
SELECT cluster, count(*) AS size, {', '.join(f"{R(f'avg({c})', 3)} AS {c}_mean" for c in ['qty', 'price', 'total'])},
       arg_min(name || ' — ' || artist, pos) AS representative
FROM oi WHERE cluster <> -1 GROUP BY cluster"""


SQL["cluster_table_keys"] = f"""WITH p AS (SELECT *, CAST(p_size % 7 - 1 AS INTEGER) AS cluster,
       CASE WHEN p_partkey % 5 = 0 THEN '?' ELSE p_brand END AS brand, CASE WHEN p_partkey % 3 = 0 THEN '?' ELSE p_size::VARCHAR END AS code FROM part),
t AS (SELECT cluster, count(*) AS size, {R('avg(p_retailprice)', 3)} AS p_retailprice_mean,
             arg_min(p_name || ' — ' || p_type, p_partkey) AS representative FROM p WHERE cluster <> -1 GROUP BY cluster),
k AS (SELECT cluster, brand FROM (SELECT cluster, brand, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, brand) AS r
      FROM p WHERE brand IS NOT NULL AND brand <> '?' GROUP BY cluster, brand) WHERE r = 1),
l AS (SELECT cluster, p_type FROM (SELECT cluster, p_type, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, p_type) AS r
      FROM p WHERE brand IS NOT NULL AND brand <> '?' AND p_type IS NOT NULL GROUP BY cluster, p_type) WHERE r = 1),
c AS (SELECT cluster, code FROM (SELECT p.cluster, p.code, row_number() OVER (PARTITION BY p.cluster ORDER BY count(*) DESC, p.code) AS r
      FROM p JOIN k ON p.cluster = k.cluster AND p.brand = k.brand WHERE p.code IS NOT NULL AND p.code <> '?' GROUP BY p.cluster, p.code) WHERE r = 1)
SELECT t.*, CASE WHEN k.brand IS NULL THEN '?' ELSE k.brand || ' ' || coalesce(l.p_type, '?') END AS dominant_category, coalesce(c.code, '?') AS dominant_code
FROM t LEFT JOIN k USING (cluster) LEFT JOIN l USING (cluster) LEFT JOIN c USING (cluster)"""


@_sql("correlation_long")
def _():
    cols = ["qty", "price", "disc", "tax", "lines", "total", "bal", "const"]
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            x, y = (a, b) if i <= j else (b, a)
            both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
            cx, cy = f"CASE WHEN {both} THEN CAST({x} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({y} AS DOUBLE) END"
            v = f"covar_pop({cx}, {cy}) / nullif(stddev_pop({cx}) * stddev_pop({cy}), 0)"
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, {R(v, 2)} AS value FROM oi")
    return f"""{WITH_ITEMS},
oi AS (SELECT *, 1.0::DOUBLE AS const FROM order_items)
{' UNION ALL '.join(parts)}"""


def _specs_sql():
    rows = ", ".join(f"('{c}', {D(lo)}, {D(hi)}, {n})" for c, lo, hi, n in C.HIST_SPECS)
    return f"specs(feature, lo, hi, bins) AS (VALUES {rows})"


HIST_BASE = f"""{WITH_ITEMS},
{_specs_sql()},
long AS ({long_sql('order_items', [s[0] for s in C.HIST_SPECS])}),
j AS (SELECT l.feature, least(greatest(l.value, s.lo), s.hi) AS clipped, s.lo, s.hi, s.bins
      FROM long l JOIN specs s ON l.feature = s.feature WHERE l.value IS NOT NULL),
counts AS (SELECT feature, CAST(least(floor((clipped - lo) / (hi - lo) * bins) + 1, bins) AS INTEGER) AS bin,
                  count(*) AS count FROM j GROUP BY 1, 2),
grid AS (SELECT feature, lo, hi, bins, CAST(unnest(range(1, bins + 1)) AS INTEGER) AS bin FROM specs),
hist AS (SELECT g.feature, g.bin, {R('(g.bin - 1) * ((g.hi - g.lo) / g.bins) + g.lo', 6)} AS bin_lo,
                {R('g.bin * ((g.hi - g.lo) / g.bins) + g.lo', 6)} AS bin_hi,
                CAST(coalesce(c.count, 0) AS BIGINT) AS count
         FROM grid g LEFT JOIN counts c ON g.feature = c.feature AND g.bin = c.bin)"""

SQL["histogram"] = f"{HIST_BASE}\nSELECT * FROM hist"
SQL["histogram_summary"] = f"""{HIST_BASE}
SELECT m.feature, m.mean_clipped, p.peak
FROM (SELECT feature, {R('avg(clipped)', 6)} AS mean_clipped FROM j GROUP BY feature) m
JOIN (SELECT feature, max(count) AS peak FROM hist GROUP BY feature) p ON m.feature = p.feature"""

SQL["category_counts"] = f"""WITH ord(category, ord) AS (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(C.PRIORITY_ORDER))})
SELECT o.category, o.ord, c.n
FROM (SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1) c
JOIN ord o ON c.category = o.category"""

SQL["status_counts"] = """WITH lab(category, ord) AS (VALUES ('F', 0), ('O', 1))
SELECT l.category, l.ord, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM lab l LEFT JOIN (SELECT o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1) c
ON l.category = c.category"""

SQL["dominant_category"] = """WITH valid AS (SELECT * FROM part WHERE p_brand IS NOT NULL AND p_brand <> '?'),
counts AS (SELECT p_type, p_brand, count(*) AS n FROM valid GROUP BY 1, 2),
top AS (SELECT p_type, p_brand AS top, n AS top_n FROM (
          SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand ASC) AS rn FROM counts)
        WHERE rn = 1),
sc AS (SELECT p.p_type, p.p_size, count(*) AS n2 FROM part p JOIN top t ON p.p_type = t.p_type AND p.p_brand = t.top
       WHERE p.p_size IS NOT NULL GROUP BY 1, 2),
sec AS (SELECT p_type, p_size AS top_second FROM (
          SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n2 DESC, p_size ASC) AS rn FROM sc)
        WHERE rn = 1),
groups AS (SELECT DISTINCT p_type FROM part)
SELECT g.p_type, coalesce(t.top, '?') AS top_brand, t.top_n AS top_count, s.top_second AS top_size
FROM groups g LEFT JOIN top t ON g.p_type = t.p_type LEFT JOIN sec s ON g.p_type = s.p_type"""


@_sql("radar")
def _():
    import math
    cols = ["qty", "price", "disc", "tax", "bal"]
    n = len(cols)
    b = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    s = ", ".join(f"({c} - lo_{c}) / (hi_{c} - lo_{c}) AS {c}" for c in cols)
    m = ", ".join(f"avg({c}) AS {c}" for c in cols)
    pts = [f"SELECT {i} AS i, '{c}' AS feature, {c} AS mean, {D(2 * math.pi * i / n - math.pi / 2)} AS angle FROM m"
           for i, c in enumerate(cols)]
    pts.append(f"SELECT {n} AS i, '{cols[0]}' AS feature, {cols[0]} AS mean, {D(-math.pi / 2)} AS angle FROM m")
    return f"""{WITH_ITEMS},
b AS (SELECT {b} FROM order_items),
s AS (SELECT {s} FROM order_items, b),
m AS (SELECT {m} FROM s),
pts AS ({' UNION ALL '.join(pts)})
SELECT i, feature, {R('mean', 6)} AS mean, {R('mean * cos(angle)', 6)} AS x, {R('mean * sin(angle)', 6)} AS y
FROM pts"""


SQL["complete_case"] = f"""{WITH_ITEMS}
SELECT row_id, {', '.join(f"{R(c, 6)} AS {c}" for c in ITEM_FEATURES)}
FROM order_items WHERE {not_null(ITEM_FEATURES)}"""

_IMP = ["qty", "price", "disc", "tax", "release_year"]
SQL["median_impute"] = f"""{WITH_ITEMS},
med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in _IMP)} FROM order_items)
SELECT row_id, {', '.join(f"{R(f'coalesce(CAST({c} AS DOUBLE), m_{c})', 6)} AS {c}" for c in _IMP)}
FROM order_items, med"""


def _zscore_sql(src: str, cols) -> str:
    out = []
    for c in cols:
        z = (f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
             f"ELSE 0.0::DOUBLE END")
        out.append(f"{R(z, 6)} AS {c}")
    return f"SELECT row_id, {', '.join(out)} FROM {src}"


_STD_COLS = ITEM_FEATURES + ["release_year"]
STD_BASE = f"""{WITH_ITEMS},
{CLEAN},
f AS (SELECT row_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ITEM_FEATURES)},
             coalesce(CAST(release_year AS DOUBLE), (SELECT quantile_cont(release_year, 0.5) FROM clean)) AS release_year
      FROM clean)"""
SQL["standardise"] = f"{STD_BASE}\n{_zscore_sql('f', _STD_COLS)}"
SQL["scaler"] = f"""{STD_BASE}
{' UNION ALL '.join(f"SELECT '{c}' AS feature, {R(f'avg({c})', 6)} AS mean, {R(f'stddev_pop({c})', 6)} AS std_pop FROM f" for c in _STD_COLS)}"""

_META = ["release_year", "lines", "explicit"]
SQL["metadata_matrix"] = f"""{WITH_ITEMS},
med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in _META)} FROM order_items),
f AS (SELECT row_id, {', '.join(f'coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}' for c in _META)}
      FROM order_items, med)
{_zscore_sql('(SELECT * FROM f WHERE lines IS NOT NULL)', _META)}"""


from featurelens.plans import oracle_ingest  # noqa: E402,F401
from featurelens.plans import oracle_explore  # noqa: E402,F401
from featurelens.plans import oracle_similarity  # noqa: E402,F401
from featurelens.plans import oracle_sinks  # noqa: E402,F401
from featurelens.plans import oracle_models  # noqa: E402,F401
