"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes what the one before it kept and returns the columns of `documents`; the last one
adds shard, slot and what they follow from. Between stages the table is written and read again.
No SQL counterpart: fingerprints, language scores and templates are beyond it.

Defined results
    null, empty or blank text   no language: the document goes in the first stage
    one id with unlike texts    documents of their own in every stage
    repeated rows               one SimHash component: one row stays
    null ids                    after all others of their component; else like any id
    very long texts             whole in every stage
    empty table                 no rows
    other columns               kept, of any type and name, as far as the last stage, which adds its own
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windspan.llm import decontam, language, mixing, sharding, simhash
from windspan.session import written


def name_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, null or without letters, go."""
    return language.identified_only(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.representatives(docs, shingle=3, max_bits=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, reworded parameters included, go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean(docs, items, window=8, run=13)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document is repeated as often as the mix takes it."""
    return mixing.mix(docs, weights=(1, 2, 3), most=3)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards along the Hilbert curve."""
    return sharding.assign(docs, shards=8)


STAGES = [
    ("language", name_language),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
