"""Corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of ``documents``: stages one to three keep rows,
the fourth replaces personal data in the texts, the last gives the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from urlsift.llm.common import table
from urlsift.llm.queries import split_pattern, vocabulary
from urlsift.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules (base rules and the divergence verdict)."""
    from urlsift.llm.quality_divergence import keep_passing

    return keep_passing(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest stays."""
    from urlsift.llm.exact_dedup import drop_exact_duplicates

    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    from urlsift.llm.jaccard_groupjoin import drop_near_duplicates

    return drop_near_duplicates(docs, **NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text replaced by a mark of its kind."""
    from urlsift.llm.pii_weak import redact

    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as packed token sequences."""
    from urlsift.llm.packing import pack_documents

    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), split_pattern())


# near-duplicate stages on word shingles: five words, similarity 0.8
NEAR = {"words": 5, "percent": 80}
STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None  # tokenisation cannot be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage results lie in the shared folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
