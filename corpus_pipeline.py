"""A corpus pipeline of five stages; each reads what the one before it kept.

``run(spark, sf_dir)`` applies the stages to the table ``documents``; between
two stages the rows are written as Parquet in the shared folder and read again.
All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelens.llm import bpe, decontaminate, exact_dedup, language, ngram_join
from featurelens.llm.catalogue import ranks_path
from featurelens.llm.staging import prepare
from featurelens.session import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; one of several languages has a main one, whatever its share."""
    model = language.train(docs)
    found = language.identify(docs.withColumnsRenamed({"lang_pred": "_in_lang_pred", "score": "_in_score"}), model)
    kept = found.where(F.col("lang_pred") != language.UNKNOWN)
    return kept.drop("lang_pred", "score").withColumnsRenamed({"_in_lang_pred": "lang_pred", "_in_score": "score"}).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.distinct_documents(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 the document with the smallest id."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    encoded = bpe.round_trip(docs.select("doc_id", "text"), ranks_path())
    whole = F.coalesce("text", F.lit("")).cast("binary") == F.col("decoded")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("decodes"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: Language and decontamination stages cannot be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
