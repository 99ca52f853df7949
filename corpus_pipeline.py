"""The corpus pipeline: documents that the quality model accepts, that aren't toxic, one of each group of near copies, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import packing, quality, shingle_join, toxicity
from lumenfold.llm.common import remove, shared_dir, written


#: Parts of texts that a packing worker keeps: it comes after three stages on the same executors.
KEPT_PARTS = 200_000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, fitted on the labelled ones of docs outside the held-out fold, takes for quality 1."""
    return quality.keep_good(docs, _labels(spark, sf_dir))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, fitted likewise, doesn't call toxic."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by shingle sets; rows without words or doc_id stay."""
    return shingle_join.keep_one(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), most=KEPT_PARTS)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("packing", packed_sequences),
]
#: SQL can express neither the trained models nor the tokenizer: tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
        if before:
            remove(spark, folder, before)
        before = name
    return docs
