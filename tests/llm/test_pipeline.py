"""Each stage of the pipeline on what the one before it kept."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F
from test_mixing import naive as naive_mix
from test_simhash import naive_components, naive_fingerprint

from windspan.llm import decontam
from windspan.session import written


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = [docs]
    for name, stage in pipeline.STAGES:
        made.append(written(stage(spark, made[-1], sf_dir), f"test-{name}"))
    return made


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(steps):
    assert [n for n, _ in pipeline.STAGES] == [
        "language", "simhash", "decontamination", "mixing", "sharding",
    ]
    for df in steps[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {"shard", "slot"} <= set(steps[-1].columns)


def test_language_keeps_documents_with_letters(steps):
    wanted = sorted(r.doc_id for r in steps[0].collect() if any(c.isalpha() for c in r.text or ""))
    assert ids(steps[1]) == wanted


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, naive_fingerprint(r.text)) for r in steps[1].collect()]
    assert ids(steps[2]) == sorted(set(naive_components(rows)))


def test_leaks_go(spark, sf_dir, steps):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = {r.doc_id for r in decontam.leaks(steps[2], items).collect()}
    assert gone and ids(steps[3]) == [i for i in ids(steps[2]) if i not in gone]


def test_mix_takes_effect(steps):
    taken = naive_mix([(r.doc_id, r.text, r.source) for r in steps[3].collect()])
    wanted = sorted(key for key, size, _, _, words in taken for _ in range(words // size))
    assert ids(steps[4]) == wanted


def test_shards_hold_all(steps):
    assert ids(steps[5]) == ids(steps[4])
    counts = [r["count"] for r in steps[5].groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1


def test_run(spark, sf_dir, steps):
    made = pipeline.run(spark, sf_dir)
    names = ("doc_id", "shard", "slot")
    assert sorted(map(tuple, made.select(*names).collect())) == sorted(
        map(tuple, steps[-1].select(*names).collect())
    )
    assert pipeline.ORACLE_SQL is None


def through(spark, docs, sf_dir):
    made = []
    for name, stage in pipeline.STAGES:
        kept = written(stage(spark, docs, sf_dir), name)
        made.append((name, kept))
        docs = kept
    return made


def test_rows_of_every_kind(spark, clashing, sf_dir):
    """Null, empty, blank, repeated and very long rows, clashing names and a map column."""
    docs = clashing.withColumn("tags", F.create_map(F.lit("a"), F.col("n_chars")))
    made = through(spark, docs, sf_dir)
    for name, kept in made[:-1]:
        assert kept.columns == docs.columns, name
    assert set(docs.columns) <= set(made[-1][1].columns)
    texts = {r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.text for r in made[1][1].collect()} == texts  # nothing near any other here
    assert {r.text for r in made[2][1].collect()} == texts


def test_no_rows(spark, empty, sf_dir):
    for name, kept in through(spark, empty, sf_dir):
        assert kept.count() == 0, name
