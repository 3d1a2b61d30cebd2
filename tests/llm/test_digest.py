"""Digests: windows and features against slow ones, neighbours against a sorted list."""

import hashlib
import math

import numpy as np
import pytest

from windspan.llm import digest


def entropy(window):
    counts = np.bincount(np.frombuffer(window, np.uint8))
    p = counts[counts > 0] / len(window)
    return float(-(p * np.log2(p)).sum())


def texts():
    rng = np.random.default_rng(3)
    yield b"a" * 200
    yield b"abc" * 60
    yield bytes(rng.integers(97, 110, 500, dtype=np.uint8))
    yield bytes(rng.integers(0, 256, 300, dtype=np.uint8))
    yield "ñandú und Übermut, ".encode() * 20
    yield bytes(rng.integers(97, 123, digest.WINDOW, dtype=np.uint8))


@pytest.mark.parametrize("text", list(texts()))
def test_ranks_are_entropies(text):
    ranks = digest.window_ranks(np.frombuffer(text, np.uint8))
    n, w = len(text), digest.WINDOW
    assert len(ranks) == n - w + 1
    for i, rank in enumerate(ranks.tolist()):
        assert rank / (1 << 20) / w + math.log2(w) == pytest.approx(entropy(text[i : i + w]), abs=1e-4)


@pytest.mark.parametrize("text", list(texts()))
def test_features_are_local_peaks(text):
    ranks = digest.window_ranks(np.frombuffer(text, np.uint8)).tolist()
    r, found = digest.REACH, []
    for i, x in enumerate(ranks):
        if all(x > y for y in ranks[max(0, i - r) : i]) and all(x >= y for y in ranks[i + 1 : i + 1 + r]):
            found.append(digest.xxhash.xxh64_intdigest(text[i : i + digest.WINDOW]))
    assert digest.features([text])[0] == list(dict.fromkeys(found)) != []


def test_texts_of_a_chunk_do_not_meet():
    some = [*texts(), b"", b"short", *texts()]
    assert digest.features(some) == [digest.features([t])[0] for t in some]
    for a, b in zip(digest.filters(some), some):
        assert np.array_equal(a, digest.filters([b])[0])


def test_likeness():
    rng = np.random.default_rng(5)
    a, b = (bytes(rng.integers(97, 123, 20_000, dtype=np.uint8)) for _ in range(2))
    mixed = a[:10_000] + b[:10_000]
    fa, fb, fm = digest.filters([a, b, mixed])
    nothing = digest.filters([b""])[0]
    assert len(fa) > 2 and digest.likeness(fa, fa) == 1 and digest.likeness(nothing, nothing) == 1
    assert digest.likeness(fa, fb) < 0.1 and digest.likeness(fa, nothing) == 0
    assert 0.35 < digest.likeness(fa, fm) < 0.7
    assert digest.likeness(fa, fm) == digest.likeness(fm, fa)


def check(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    found = digest.fingerprints(docs).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for (key, text), (_, after) in zip(rows, [*rows[1:], *rows[:1]]):
        changed = digest.edited(text, after).encode()
        own, other, edit = digest.filters([text.encode(), after.encode(), changed])
        wanted = (
            len(text),
            hashlib.sha256(changed).hexdigest(),
            digest.as_text(own),
            digest.as_text(edit),
            pytest.approx(digest.likeness(own, edit)),
            pytest.approx(digest.likeness(own, other)),
        )
        assert any(tuple(r)[1:] == wanted for r in by_id[key])


def test_given_documents(documents, monkeypatch):
    check(documents)
    monkeypatch.setattr(digest, "ROWS_PER_SLICE", 7)  # many slices
    check(documents)


def test_slices_of_crowded_and_distant_ids(spark, monkeypatch):
    monkeypatch.setattr(digest, "ROWS_PER_SLICE", 2)
    ids = [-(1 << 62), -5, 0, 1, 2, 3, 4, 5, 6, (1 << 62)]
    check(spark.createDataFrame([(i, f"text {i} " * 20) for i in ids], "doc_id long, text string"))


def test_edge_cases(spark, edges, clashing, empty):
    unique = edges.filter("doc_id is not null and doc_id < 6 or doc_id > 7")
    check(unique)
    assert digest.fingerprints(clashing).count() == clashing.count()
    assert digest.fingerprints(empty).count() == 0
    check(spark.createDataFrame([(1, "alone in the table, a text of one row")], "doc_id long, text string"))
    check(spark.createDataFrame([(None, "nameless text")], "doc_id long, text string"))
    same = digest.fingerprints(edges).filter("doc_id = 6").select("fingerprint").distinct()
    assert same.count() == 1
