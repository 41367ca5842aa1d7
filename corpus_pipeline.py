"""A training-data pipeline: language ID, quality, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents, for the
documents that they keep; the last returns the pieces of packed sequences. run() writes what each
stage returns to the shared folder, as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import exact_dedup, language_id, near_dedup, packing, quality
from shelfwise.llm.common import written


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 1000, as 10,000 at once take much of an executor's memory, in both processes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an unknown language, or in none (null and blank texts, and texts without letters), go. Repeated rows are judged alike; an empty table stays empty."""
    _small_batches(spark)
    return language_id.drop_unidentified(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly bad go; null and blank texts have no line and are judged by the classifier's prior. Repeated rows are judged alike; an empty table stays empty."""
    _small_batches(spark)
    return quality.drop_bad(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the least id stays: by op3's rule, or alike by five words at 0.8."""
    _small_batches(spark)
    return near_dedup.drop_near_copies(docs, radius=2, shingle=3, least=0.8, words=5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. Null and blank texts are packed as their end alone; repeated rows are packed each; an empty table gives no piece."""
    _small_batches(spark)
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("packing", pack_sequences),
]

#: Its first stages are learned models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
