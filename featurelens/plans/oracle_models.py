"""SQL twins for the density clusters: explicit eps-pairs and a recursive
closure over core-core edges (feasible at the check scale only)."""

from __future__ import annotations

from featurelens.plans.model_queries import DBSCAN_EPS, DBSCAN_MIN, VECTOR_EPS
from featurelens.plans.oracle import D, SQL

_Z = {c: f"(CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in ("p_size", "p_retailprice")}

DBSCAN_BASE = f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, {_Z['p_size']} AS a, {_Z['p_retailprice']} AS b FROM part),
near AS (SELECT x.id AS src, y.id AS dst FROM p x JOIN p y
         ON (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= {D(DBSCAN_EPS)} * {D(DBSCAN_EPS)}),
deg AS (SELECT src AS id, count(*) >= {DBSCAN_MIN} AS core FROM near GROUP BY src),
cedge AS (SELECT n.src, n.dst FROM near n JOIN deg s ON n.src = s.id AND s.core JOIN deg t ON n.dst = t.id AND t.core),
reach(id, r) AS (SELECT id, id FROM deg WHERE core
                 UNION SELECT e.dst, reach.r FROM reach JOIN cedge e ON reach.id = e.src),
comp AS (SELECT id, min(r) AS comp FROM reach GROUP BY id),
num AS (SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT comp FROM comp)),
core_lab AS (SELECT c.id, n.cluster FROM comp c JOIN num n ON c.comp = n.comp),
border AS (SELECT n.src AS id, min(cl.cluster) AS cluster FROM near n JOIN deg d ON n.src = d.id AND NOT d.core
           JOIN core_lab cl ON n.dst = cl.id GROUP BY n.src),
lab AS (SELECT p.id AS p_partkey, CAST(coalesce(cl.cluster, b.cluster, -1) AS INTEGER) AS cluster
        FROM p LEFT JOIN core_lab cl ON p.id = cl.id LEFT JOIN border b ON p.id = b.id)"""

SQL["dbscan"] = f"{DBSCAN_BASE}\nSELECT p_partkey, cluster FROM lab"
SQL["dbscan_summary"] = f"""{DBSCAN_BASE}
SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
       count(*) FILTER (WHERE cluster = -1) AS n_noise FROM lab"""

SQL["dbscan_vectors"] = DBSCAN_BASE.replace(DBSCAN_BASE[:DBSCAN_BASE.index("deg AS")], f"""WITH RECURSIVE p AS (
    SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT x.id AS src, y.id AS dst FROM p x JOIN p y ON list_distance(x.v, y.v) <= {D(VECTOR_EPS)}),
""").replace("p_partkey", "vec_id") + "\nSELECT vec_id, cluster FROM lab"
