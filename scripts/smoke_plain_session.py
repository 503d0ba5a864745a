"""Driver-like smoke run: a plain SparkSession (none of the package's defaults),
the entry module loaded by file path, every query executed.

usage: (from any folder) python /root/repo/scripts/smoke_plain_session.py [sf_dir]
"""

from __future__ import annotations

import importlib.util
import os
import sys
import time

from pyspark.sql import SparkSession


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("entry_under_test", os.path.join(here, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8") \
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    t = time.time()
    print("entry rows", entry.entry(spark).count(), round(time.time() - t, 1), flush=True)
    failed = []
    t0 = time.time()
    for key, fn in entry.queries().items():
        try:
            fn(spark, sf_dir).collect()
        except Exception as e:  # noqa: BLE001
            failed.append((key, f"{type(e).__name__}: {str(e)[:200]}"))
    print("queries", len(entry.queries()), "failed", failed, "seconds", round(time.time() - t0, 1))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
