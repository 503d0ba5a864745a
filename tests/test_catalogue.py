"""The catalogue against its DuckDB twins on the smallest benchmark tables,
the driver contract, and plan checks (pushdown, top-N, no Python in the
relational queries)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from featurelens.plans.catalogue import QUERIES as OWN
from featurelens.sources.tables import TABLES

from conftest import SF_SMALL

# the queries of optional subpackages are tested with them
SQL = {k: v for k, v in entry.oracle_sql().items() if k in OWN}
QUERIES = {k: v for k, v in entry.queries().items() if k in OWN}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_a_key_and_most_have_sql():
    assert len(QUERIES) >= 70
    assert set(SQL) <= set(QUERIES)
    no_sql = set(QUERIES) - set(SQL)
    assert no_sql <= {"pca", "pca_variance", "kmeans", "optimal_k", "dbscan", "dbscan_summary", "agglomerative", "linkage_single", "linkage_average", "linkage_complete",
                      "isolation_forest", "embed2d", "bisecting_tree"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql_twin(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(SQL[key])
    want = _rows([d[0] for d in res.description], res.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in res.description)
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["year", "feature", "mean", "median", "std", "count", "band_lo", "band_hi"]


def test_plans(spark):
    from pyspark.sql import functions as F

    from featurelens.sources.tables import load

    li = load(spark, SF_SMALL, "lineitem").filter(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")
    plan = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    top = QUERIES["top_n"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
    for key in ("yearly_trend", "correlation_long", "positional_fallback", "histogram", "knn_one"):
        p = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "FlatMapGroupsInPandas" not in p


def test_kmeans_inertia_not_above_label_partition(spark):
    from pyspark.sql import functions as F

    from featurelens.operators import quality
    from featurelens.plans.model_queries import embeddings_2d

    coords = embeddings_2d(spark, SF_SMALL).withColumn("v", F.array("pc1", "pc2"))
    by_label = quality.inertia(coords, "label", "v").first()["inertia"]
    scan = {r.k: r for r in QUERIES["optimal_k"](spark, SF_SMALL).collect()}
    assert scan[10].inertia <= by_label
    assert sum(1 for r in scan.values() if r.best) == 1
    assert scan[2].inertia >= scan[10].inertia
