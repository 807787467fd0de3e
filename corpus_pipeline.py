"""A corpus pipeline of five stages: language, quality, near duplicates, source mix, token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import jaccard_join, language_id, mixing, packing, quality_classifier
from driftloom.llm._common import discard, shuffle_partitions, table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; those without a label get theirs."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good rather than not, by a classifier learned from the labels."""
    return quality_classifier.keep_good(docs, quality_classifier.learn(docs, table(spark, sf_dir, "labels")))


def first_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return jaccard_join.keep_first(docs)


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the source mix, which ``mixing.written_position`` reads back."""
    return mixing.mixed(docs, shuffle_partitions(spark))


def in_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token windows, in the order of the mix; neighbours come from the same stretch of it."""
    return packing.pack(mixing.written_position(docs), order=F.col("position")).drop("row")


STAGES = [
    ("language_id", identified),
    ("quality_classifier", good),
    ("jaccard_join", first_of_copies),
    ("mixing", in_mixed_order),
    ("packing", in_windows),
]

#: The stages learn models and search lexically: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again as the next one's documents, then deleted."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
        before = docs
    return docs
