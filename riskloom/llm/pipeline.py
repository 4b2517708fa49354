"""Corpus pipeline: toxicity, language, near-duplicates, packing.

Every stage works on all rows that its predecessor kept. The first three return the
columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import Scratch
from . import language, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; labels teach from outside fold 1 of 3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_unknown(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; languages are learned outside fold 0 of 5."""
    train = ~language.held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull()
    return language.keep_known(docs, language.fit(docs, train))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in bins."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown),
    ("simhash_near_dedup", drop_copies),
    ("best_fit_packing", pack),
]

#: Learned models and fingerprints have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = s.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
