"""A corpus pipeline: each stage works on all that the one before it kept.

Quality classifier, exact dedup, near duplicates, benchmark decontamination, packing. All stages but the last return the columns of
``documents``; the last returns the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quay.llm import decontam, exact, jaccard, packing, quality, shared
from quay.llm.queries import TOKENIZER, table

#: Documents that score less are rejected.
LEAST_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what a classifier, learned from the labelled rows that are not held out, rejects."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~quality.held_out(F.col("doc_id")))
    return quality.keep(docs, quality.learn(docs, labels), least=LEAST_QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact.kept_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least doc_id stays."""
    return jaccard.kept_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out benchmark passages; drop documents of which more than half is hit."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of at most 2048 token ids."""
    return packing.pack(docs, TOKENIZER, longest=2048, end_id=1, added=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near duplicates", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.stored(docs, f"stage{k}")
    return docs
