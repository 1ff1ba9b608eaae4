"""A training corpus from ``documents``: filtered, deduplicated, decontaminated, mixed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurelens.llm import decontamination, mixing, near_duplicates, quality, sharding
from lurelens.llm.common import limit_batches, stored, table

#: Parts of the tokens of toxic domains that are to stay; the other domains keep theirs. Documents are dropped for it, never
#: repeated.
WEIGHTS = {"quality0_toxic1": 0.3, "quality1_toxic1": 0.3}
SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    limit_batches(spark)
    return quality.good_documents(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    limit_batches(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the labelled domains come as near to their target shares as dropping allows."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), WEIGHTS, relative=True)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot; each shard has the mixture of sources of the whole."""
    return sharding.interleaved_shards(docs, shards=SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicate_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", target_weights),
    ("sharding", sharded),
]
#: No SQL: signatures, posteriors and divergences are no SQL functions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each works on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
