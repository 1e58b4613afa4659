"""From raw documents to training shards: quality, near-duplicates, benchmark leaks, mixing, sharding.

Each stage works on all that its predecessor kept, and each is written and read again before the next.
Null texts are empty ones, which the classifier judges by its bias; of near copies the row with the
least id stays, null ids only where there is no other; rows that repeat stand for one document; an
empty table gives an empty result; columns that documents have besides their own pass through, and a
column ``shard`` gives way to the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import decontamination, mixing, quality, sharding, similar
from emberlog.llm.common import read, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies: SimHash candidates, confirmed by
    a Jaccard similarity of five-word shingles of 0.8 or more."""
    return similar.distinct_documents(docs, shingle=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for, in training order."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each row and sorts by shard along the curve."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Trained models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
