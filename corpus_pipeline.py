"""A corpus pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage gets what the one before kept; all but the last return the columns of
``documents``. A part of the training-data operators, though it lies here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointflux.llm import mixing, packing, pii, quality, simhash_dedup
from pointflux.llm.common import discard, new_path, scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_documents(docs, quality.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five-word shingle sets at 0.8 or more: the one with the smallest doc_id."""
    return simhash_dedup.one_of_each(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` keeps the original's."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in bins."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Fingerprints, the fitted classifier and best-fit order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each is written and read again by the next.

    What a stage wrote for itself goes once its result is written, and a stage's
    result goes once the next one's is; the tables that the last stage reads stay.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
