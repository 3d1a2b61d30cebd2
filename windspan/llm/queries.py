"""One query per operator, over whole tables of the given folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windspan.llm import (
    decontam,
    digest,
    divergence,
    interactions,
    language,
    mixing,
    phrases,
    pii,
    quality,
    secrets_ledger,
    sharding,
    simhash,
    warc,
)
from windspan.llm.oracle import ORACLE_SQL as ORACLE_SQL
from windspan.session import new_table_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


#: The key of the query; a real run passes its own.
DEMO_KEY = b"windspan demonstration key 000001"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymised(_table(spark, sf_dir, "documents"), DEMO_KEY)
    return docs.select("doc_id", "text", "n_values", "kinds")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"), revisit_from=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.classify(docs, labels, cut=0.3)


def op8_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(_table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontam.leaks(docs, items, window=8, run=13)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.strip_recurring(spark, _table(spark, sf_dir, "documents"), window=35)


def op11_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return interactions.audit(docs, labels)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"), least_docs=3, top=200)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first scan: the ledger is new, so every blob is unseen."""
    return secrets_ledger.scan(
        _table(spark, sf_dir, "documents"), new_table_dir(spark, "secrets-ledger")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_pii,
        op3_warc,
        op4_sharding,
        op5_language,
        op6_mixing,
        op7_quality,
        op8_digest,
        op9_decontam,
        op10_substrings,
        op11_interactions,
        op12_divergence,
        op13_secrets,
    )
}
