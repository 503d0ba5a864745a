"""Session construction and the shared scratch location.

Iterative operators cut lineage with ``DataFrame.checkpoint()`` and sinks
write stage tables; both go below the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent (local tests) do
we create a private folder and register it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Settings for a large cluster (hundreds of TB): many initial shuffle
# partitions that AQE coalesces to ~256 MB, 256 MB scan splits, skew-join
# splitting, and broadcasts only under AQE's runtime size check.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "featurelens", extra: dict | None = None,
                cluster: bool = False) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    ``cluster=True`` adds ``CLUSTER_CONF`` (without a driver-memory default).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if cluster:
        conf.pop("spark.driver.memory", None)
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    ensure_code(spark)
    return spark


def shared_dir(spark: SparkSession, sub: str | None = None) -> str:
    """Return the shared checkpoint folder (creating a local one only if unset).

    With ``sub`` a fresh unique child path is returned for a stage table.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        # Unset only in local tests: a private folder stands in for the shared one.
        base = tempfile.mkdtemp(prefix="featurelens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # core setting may be read-only at runtime
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    if sub is None:
        return base
    return os.path.join(base, "featurelens", f"{sub}-{uuid.uuid4().hex[:12]}")


def ensure_code(spark: SparkSession) -> None:
    """Ship this package to the executors once per SparkContext.

    Operators that run numpy inside tasks (``applyInPandas`` / ``mapInPandas``)
    need ``featurelens`` importable in every Python worker. The package is
    zipped on the driver and distributed with ``SparkContext.addPyFile``.
    """
    sc = spark.sparkContext
    if getattr(sc, "_featurelens_code", None):
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="featurelens-code-"), "featurelens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._featurelens_code = out


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as a Parquet table below ``folder`` and read again; the caller removes the folder.

    For what goes from round to round: a checkpoint keeps what Spark knows of the plan
    (how joined sides are partitioned), which doubles with every round's joins until
    planning takes minutes. A table read from files has none of it.
    """
    path = os.path.join(folder, uuid.uuid4().hex[:12])
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder written by an earlier round (works on any Hadoop filesystem)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.exists(p):
        fs.delete(p, True)
