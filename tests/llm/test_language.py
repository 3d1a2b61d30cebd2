"""Language identification: held-out accuracy, backing off, defined results."""

import zlib

import pytest

from windspan.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    found = language.identify(docs).collect()
    assert {r.doc_id for r in found} == set(known)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.lang_pred in set(known.values())
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) / len(held) > 0.98


@pytest.fixture(scope="module")
def small(spark):
    rows = [("en", "the river and the house"), ("fr", "la maison et le jardin")] * 3
    return spark.createDataFrame([(l, t) for l, t in rows], "lang string, text string")


def test_unseen_words_back_off(small):
    model = language.learn(small)
    assert model.languages == ["en", "fr"]
    assert "houses" not in model.words and model.predict("houses")[0] == "en"
    assert "jardins" not in model.words and model.predict("jardins")[0] == "fr"
    assert model.predict("ж") == model.predict("щщщ")  # letters never seen tell nothing


def test_whole_text_counts(small):
    model = language.learn(small)
    assert model.predict("the " + "maison " * 5_000)[0] == "fr"


def test_forgetting_words_changes_nothing(small, monkeypatch):
    texts = ["houses rivers", "jardins", "the " + " ".join(f"wörd{i:x}" for i in range(50))]
    model = language.learn(small)
    before = [model.predict(t) for t in texts]
    monkeypatch.setattr(language, "KEPT_WORDS", 6)
    model.forget()
    again = [model.predict(t) for t in texts]
    assert [a[0] for a in again] == [b[0] for b in before]
    assert [a[1] for a in again] == pytest.approx([b[1] for b in before])


def test_edge_cases(edges, clashing, empty):
    for docs in (edges, clashing):
        found = language.identify(docs).collect()
        assert len(found) == docs.count()
        for r in found:
            if r.doc_id in (1, 2, 3):
                assert (r.lang_pred, r.score) == ("und", 0.0)
    kept = language.identified_only(clashing)
    assert kept.columns == clashing.columns and kept.count() == clashing.count() - 5
    assert language.identify(empty).count() == 0
    unlabelled = edges.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
