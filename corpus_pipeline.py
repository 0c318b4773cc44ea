"""Corpus pipeline: language ID, quality, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame; ``run`` writes it as Parquet to the shared folder
and reads it back as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``.

Defined results: rows without text have no language and go in the first stage;
a null id is kept like any other; of repeated rows one stays; an empty table
gives empty stages; extra columns travel along unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, langid, near_dedup, packing, quality
from quarry.llm.common import staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough confidence stay."""
    return langid.accepted(docs, langid.train(langid.labelled_sample(docs)))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above stay."""
    return quality.accepted(docs, quality.train(quality.labelled_sample(docs, table(spark, sf_dir, "labels"))))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for blanks) the longest original stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more (5-word shingles) the smallest id stays."""
    return near_dedup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 2,048 ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("packing", pack),
]

#: SQL can't express the trained classifiers and the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
