"""A corpus made ready for training: the stages, in order, and their run.

All stages keep to this: a missing text is an empty one; an empty text has the classifier's score of one and is
nobody's duplicate; texts of any length are read whole; rows may repeat, as may ids, and missing ids
come last; tables may be empty; the columns of `documents` pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetlens.llm import decontaminate, frames, mixing, ngram_join, quality, sharding

#: Near duplicates share this many per cent of their shingles of so many words.
SHINGLE_WORDS = 5
PER_CENT = 80


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from `labels`, doesn't reject. Equal texts stay or go together."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with the smallest id, of repeated rows one.

    Documents without words are no group and all stay.
    """
    return ngram_join.one_per_group(docs, size=SHINGLE_WORDS, per_cent=PER_CENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of `benchmark`; items without words count nothing."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target weight asks for, not at all for some; a missing source is a source."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the shard and slot they go to; ties go by id and then by the number of the row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", reject_poor),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: The classifier can't be expressed in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each one's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = frames.staged(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
