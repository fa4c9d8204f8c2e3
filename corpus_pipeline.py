"""Corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output; each stage calls one llm operator."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bitplane, decontaminate, mixing, neardup, quality, queries, work


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (8): documents that fail the base rule or lie far outside their language and source go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (1): one document of each group of five-word-shingle similarity 0.8 or more stays."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (7): documents that hold a benchmark item go."""
    return decontaminate.clean(docs, work.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (5): each document as often, and as far, as the schedule takes it."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID / binary output (10): writes the shard files and reads them back; one row per document."""
    return bitplane.op10(spark, docs, queries.tokenizer_path())


def swept(stage):
    """The stage, after the shuffle files of the stages before it are let go."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        work.sweep(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", swept(quality_rules)),
    ("near_dedup", swept(near_dedup)),
    ("decontamination", swept(decontamination)),
    ("source_mixing", swept(source_mixing)),
    ("token_output", swept(token_output)),
]
#: SQL cannot express the robust estimates, the schedule or the tokenizer; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = work.saved(stage(spark, docs, sf_dir), "stage")
    return docs
