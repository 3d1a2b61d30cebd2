"""Recurring passages against a count of all windows."""

import hashlib
import random

import numpy as np
import pytest

from windspan.llm import phrases


def naive(rows, window):
    words = [(key, (text or "").encode().split()) for key, text in rows]
    seen = {}
    for _, w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for key, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs, window, **options):
    return sorted(map(tuple, phrases.strip_recurring(spark, docs, window=window, **options).collect()), key=str)


def check(spark, rows, window, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spark, docs, window, **options) == naive(rows, window)


def test_given_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(spark, documents, 35) == naive(rows, 35)


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(spark, seed):
    """Few words, so that windows overlap themselves and share anchors in all ways."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(4, 30))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    check(spark, rows, 8, shingle=3)


def test_blocks_do_not_matter(spark, documents, monkeypatch):
    wanted = got(spark, documents, 35)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 1)
    assert got(spark, documents, 35) == wanted


def test_within_one_document(spark):
    check(spark, [(1, "x y z " * 40), (2, "a b c")], 35)
    check(spark, [(1, "a " * 35), (2, "a " * 36)], 35)


def test_edge_cases(spark, edges, clashing, empty):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    for docs in (edges, clashing):
        assert got(spark, docs, 5, shingle=2) == naive(rows, 5)
        assert got(spark, docs, 35) == naive(rows, 35)
    assert phrases.strip_recurring(spark, empty).count() == 0


def test_run_hashes():
    words = [w.encode() for w in "a b c a b c d a b".split()]
    hashed = phrases.Hashed(words)
    first = np.array([0, 3, 1, 4, 7])
    found = hashed.runs(first, first + 2)
    assert found[0] == found[1] == found[4] and found[2] == found[3] != found[0]


def test_window_runs():
    def packed(*spans):
        return np.array([a << 32 | b for a, b in spans])

    assert phrases.window_runs(packed((5, 6), (0, 1), (2, 2), (6, 9))) == [(0, 2), (5, 9)]
    assert phrases.window_runs(packed()) == []
