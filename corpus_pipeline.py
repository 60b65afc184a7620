"""Corpus pipeline: quality classifier, exact dedup, near-duplicate join, mixing to targets, BPE encoding.

Every stage works on all rows of its input and takes nulls, empty and very long texts, repeated rows, empty
tables and extra columns; the last aside, a stage's columns are those of its input.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import bpe, exact_dedup, mixing, ngram_join, quality
from confab.llm.common import settled, table
from confab.sources.cluster import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of documents that are not held out.

    Each row is judged by its text alone, so repeated rows stay or go together; an empty or null text has a score too.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter("predicted = 1").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: of the most code points, then the
    smallest id. Null and empty texts are one group; of equal rows one stays."""
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; documents without id stay if their whole group has none.

    Rows that repeat the id that stays, stay too; a document without words is a group of its own.
    """
    groups = ngram_join.near_groups(docs)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as their source's target takes them, in training order; those without words go."""
    return mixing.mixed(docs, whole=True)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: token counts and digests of ids and decoded texts; a null text is empty."""
    return bpe.token_digests(docs)


def _shipped(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _shipped(quality_stage)),
    ("exact dedup", _shipped(exact_stage)),
    ("near-duplicate join", _shipped(near_stage)),
    ("mixing to target weights", _shipped(mixing_stage)),
    ("bpe encoding", _shipped(bpe_stage)),
]

#: The classifier and the near-duplicate join have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written as Parquet and read again, and what a stage wrote on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(functools.partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
