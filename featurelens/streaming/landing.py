"""Incremental landing of raw JSON payloads as Parquet (bronze).

The analysed program fetches pages over HTTP; here fetched pages arrive as
JSON files in a folder. A Structured Streaming file source with a fixed
schema picks up new files, tags each row with its source file (the page
key used for positions), and appends Parquet with exactly-once semantics
from the checkpoint. ``availableNow`` processes what is there and stops,
so the same job serves scheduled batch runs and continuous arrival.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelens.session import shared_dir


def land_json(spark: SparkSession, source_dir: str, schema: T.StructType, target_dir: str,
              checkpoint_dir: str | None = None, multiline: bool = True, wait: bool = True):
    """Start (and by default wait for) the landing query; returns the StreamingQuery."""
    ckpt = checkpoint_dir or shared_dir(spark, "landing-checkpoint")
    stream = (spark.readStream.schema(schema).option("multiLine", multiline).json(source_dir)
              .withColumn("source_file", F.col("_metadata.file_path"))
              .withColumn("landed_at", F.current_timestamp()))
    q = (stream.writeStream.format("parquet").option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start(target_dir))
    if wait:
        q.awaitTermination()
    return q
