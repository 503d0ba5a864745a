"""SQL twins for similarity, cluster-quality and outlier queries.

The oracle deliberately uses the explicit definitions (all pairs, per-row
sums) where the Spark side uses closed forms or blocked cells.
"""

from __future__ import annotations

from featurelens.plans.oracle import R, SQL, WITH_ITEMS
from featurelens.plans.similarity_queries import ANOVA_DIMS, K, OUTLIER_TOP, PCT, QUERY_VEC, SEARCH, SIMILAR_N
from featurelens.sources.tables import ITEM_FEATURES

VEC = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
              sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv
       FROM embeddings WHERE embedding IS NOT NULL)"""


def _cos(a, b, zero="0.0"):
    return f"(CASE WHEN {a}.nv * {b}.nv = 0 THEN {zero}::DOUBLE ELSE list_dot_product({a}.v, {b}.v) / ({a}.nv * {b}.nv) END)"


def _knn_one(zero):
    sim = f"CASE WHEN e.vec_id = {QUERY_VEC} THEN -2.0::DOUBLE ELSE {_cos('e', 'q', zero)} END"
    return f"""WITH {VEC},
q AS (SELECT * FROM e WHERE vec_id = {QUERY_VEC} LIMIT 1),
s AS (SELECT e.vec_id, {sim} AS raw FROM e, q),
o AS (SELECT vec_id, raw, {R('raw', 12)} AS key FROM s)
SELECT CAST(row_number() OVER (ORDER BY key DESC, vec_id ASC) AS INTEGER) AS rank, vec_id, {R('raw', 6)} AS similarity
FROM o ORDER BY key DESC, vec_id ASC LIMIT {K}"""


SQL["knn_one"] = _knn_one("0.0")
SQL["knn_one_zero_norm"] = _knn_one("-2.0")

_Z = {c: f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in ("p_size", "p_retailprice")}
_QN = "sqrt(zs * zs + zp * zp) * sqrt(qs * qs + qp * qp)"
SQL["similar_by_name"] = f"""WITH p AS (SELECT p_partkey, p_name, p_size, p_retailprice, {_Z['p_size']} AS zs,
                  {_Z['p_retailprice']} AS zp FROM part),
hit AS (SELECT p_partkey AS qk FROM part WHERE coalesce(regexp_matches(lower(p_name), '{SEARCH}'), false)
        ORDER BY p_partkey LIMIT 1),
q AS (SELECT zs AS qs, zp AS qp FROM p JOIN hit ON p.p_partkey = hit.qk),
s AS (SELECT p.*, {R(f"CASE WHEN p.p_partkey = hit.qk THEN -2.0::DOUBLE WHEN {_QN} = 0 THEN 0.0::DOUBLE ELSE (zs * qs + zp * qp) / ({_QN}) END", 12)} AS sim
      FROM p, q, hit)
SELECT CAST(row_number() OVER (ORDER BY sim DESC, p_partkey ASC) AS INTEGER) AS rank, p_partkey, p_name,
       {R(R('sim', 6), 3)} AS similarity, p_size, p_retailprice
FROM s ORDER BY sim DESC, p_partkey ASC LIMIT {SIMILAR_N}"""

SQL["knn_all"] = f"""WITH {VEC},
p AS (SELECT a.vec_id, b.vec_id AS nbr, {R(_cos('a', 'b'), 12)} AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, nbr ASC) AS rk FROM p)
SELECT vec_id, CAST(rk AS INTEGER) AS rank, nbr, {R('similarity', 6)} AS similarity FROM r WHERE rk <= {K}"""

UNNESTED = """x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
              unnest(generate_series(1, len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i)"""

SQL["representatives"] = f"""WITH {UNNESTED.replace('WHERE embedding IS NOT NULL', 'WHERE embedding IS NOT NULL AND label <> -1')},
d AS (SELECT x.vec_id, x.label, sum(x.v * c.m) AS dt, sqrt(sum(x.v * x.v)) AS nx, sqrt(sum(c.m * c.m)) AS nc
      FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY x.vec_id, x.label),
s AS (SELECT vec_id, label, {R('CASE WHEN nx * nc = 0 THEN 0.0::DOUBLE ELSE dt / (nx * nc) END', 12)} AS sim FROM d),
sz AS (SELECT label, count(*) AS cluster_size FROM embeddings WHERE label <> -1 GROUP BY label),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id ASC) AS rn FROM s)
      WHERE rn = 1)
SELECT b.label AS cluster, b.vec_id AS representative, sz.cluster_size, {R('b.sim', 3)} AS similarity_to_centroid
FROM b JOIN sz ON b.label = sz.label"""

SQL["diversity"] = f"""WITH {VEC},
p AS (SELECT 1.0 - {_cos('a', 'b')} AS dist FROM e a JOIN e b ON a.vec_id < b.vec_id),
n AS (SELECT count(*) AS n FROM e)
SELECT n.n, CASE WHEN n.n < 2 THEN 0.0::DOUBLE ELSE {R('(SELECT avg(dist) FROM p)', 4)} END AS diversity FROM n"""

_LONG = " UNION ALL ".join(f"SELECT label, 'd{i}' AS feature, CAST(embedding[{i + 1}] AS DOUBLE) AS x FROM embeddings"
                           for i in range(ANOVA_DIMS))
SQL["anova_f"] = f"""WITH long AS (SELECT * FROM ({_LONG}) WHERE x IS NOT NULL AND label <> -1),
g AS (SELECT feature, label, count(*) AS n, avg(x) AS m FROM long GROUP BY feature, label),
gm AS (SELECT feature, sum(n * m) / sum(n) AS gm, sum(n) AS nn, count(*) AS k FROM g GROUP BY feature),
ssb AS (SELECT g.feature, sum(g.n * (g.m - gm.gm) * (g.m - gm.gm)) AS ssb FROM g JOIN gm ON g.feature = gm.feature
        GROUP BY g.feature),
ssw AS (SELECT l.feature, sum((l.x - g.m) * (l.x - g.m)) AS ssw FROM long l
        JOIN g ON l.feature = g.feature AND l.label = g.label GROUP BY l.feature)
SELECT gm.feature,
       {R('CASE WHEN gm.k < 2 THEN 0.0::DOUBLE ELSE coalesce((ssb.ssb / nullif(gm.k - 1, 0)) / nullif(ssw.ssw / nullif(gm.nn - gm.k, 0), 0), 0.0::DOUBLE) END', 6)} AS F_statistic
FROM gm JOIN ssb ON gm.feature = ssb.feature JOIN ssw ON gm.feature = ssw.feature"""

_DIST = """d AS (SELECT x.vec_id, x.label, sum((x.v - c.m) * (x.v - c.m)) AS d2
      FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY x.vec_id, x.label)"""
SQL["inertia"] = f"""WITH {UNNESTED},
{_DIST}
SELECT {R('sum(d2)', 2)} AS inertia FROM d"""

SQL["davies_bouldin"] = f"""WITH {UNNESTED},
{_DIST},
s AS (SELECT label, avg(sqrt(d2)) AS s FROM d GROUP BY label),
cc AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dc
       FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label),
r AS (SELECT cc.la, max((sa.s + sb.s) / nullif(cc.dc, 0)) AS m
      FROM cc JOIN s sa ON cc.la = sa.label JOIN s sb ON cc.lb = sb.label GROUP BY cc.la)
SELECT {R('avg(m)', 4)} AS davies_bouldin FROM r"""

SQL["silhouette_exact"] = f"""WITH {VEC},
p AS (SELECT a.vec_id, a.label AS own, b.label AS other, list_distance(a.v, b.v) AS dist
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
g AS (SELECT vec_id, own, other, avg(dist) AS md FROM p GROUP BY vec_id, own, other),
sz AS (SELECT label, count(*) AS n FROM e GROUP BY label),
r AS (SELECT vec_id, max(own) AS own, max(CASE WHEN other = own THEN md END) AS a,
             min(CASE WHEN other <> own THEN md END) AS b FROM g GROUP BY vec_id),
s AS (SELECT CASE WHEN sz.n <= 1 THEN 0.0::DOUBLE
                  ELSE coalesce((r.b - r.a) / nullif(greatest(r.a, r.b), 0), 0.0::DOUBLE) END AS s,
             r.b FROM r JOIN sz ON r.own = sz.label)
SELECT CASE WHEN count(b) > 0 THEN {R('avg(s)', 4)} END AS silhouette FROM s"""

SQL["silhouette_squared"] = SQL["silhouette_exact"].replace(
    "list_distance(a.v, b.v) AS dist", "pow(list_distance(a.v, b.v), 2) AS dist").replace("AS silhouette FROM s", "AS silhouette_squared FROM s")


def _scores():
    cols = ITEM_FEATURES
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in cols)
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in cols)
    z = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
                  f"ELSE 0.0::DOUBLE END AS {c}" for c in cols)
    score = " + ".join(f"{c} * {c}" for c in cols)
    return f"""{WITH_ITEMS},
med AS (SELECT {med} FROM order_items),
f AS (SELECT row_id, {fill} FROM order_items, med),
z AS (SELECT row_id, {z} FROM f),
sc AS (SELECT row_id, -({score}) AS s FROM z),
thr AS (SELECT quantile_cont(s, {PCT / 100.0}) AS t FROM sc),
lab AS (SELECT row_id, s, CASE WHEN s < t THEN -1 ELSE 1 END AS outlier_label FROM sc, thr)"""


SQL["rethreshold"] = f"""{_scores()}
SELECT row_id, {R('s', 6)} AS anomaly_score, outlier_label FROM lab"""

SQL["outlier_top"] = f"""{_scores()}
SELECT o.row_id, o.name, o.artist, {R('l.s', 6)} AS anomaly_score,
       {', '.join(f"{R(f'o.{c}', 6)} AS {c}" for c in ['qty', 'price', 'disc', 'tax', 'total', 'bal'])}
FROM order_items o JOIN lab l ON o.row_id = l.row_id
WHERE l.outlier_label = -1 ORDER BY l.s ASC, o.pos ASC LIMIT {OUTLIER_TOP}"""

SQL["positional_attach"] = f"""{_scores()}
SELECT o.row_id, o.name, o.cluster, {R('l.s', 6)} AS anomaly_score, l.outlier_label
FROM order_items o LEFT JOIN lab l ON o.row_id = l.row_id"""

SQL["outlier_share"] = f"""{_scores()}
SELECT count(*) AS n, count(*) FILTER (WHERE outlier_label = -1) AS n_outliers,
       {R('(count(*) FILTER (WHERE outlier_label = -1)) * 100.0 / count(*)', 1)} AS pct_outliers
FROM lab"""
