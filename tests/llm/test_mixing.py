"""Mixing: targets by repeated resharing, takes by hash order."""

import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import Row

from windspan.llm import mixing


def naive_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: Fraction(weight[s] * rest, sum(weight[f] for f in free)) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, Fraction(most * sizes[s])) for s in names}
        full |= over


@pytest.mark.parametrize("weights", [(1, 2, 3), (1,), (5, 1)])
@pytest.mark.parametrize("most", [1, 3])
def test_targets(spark, weights, most):
    sizes = {"a": 100, "b": 5, "c": 0, "é": 77, "Z": 1000, "b2": 1, None: 60}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    wanted = naive_targets(sizes, weights, most)
    for r in mixing.targets(df, weights, most).collect():
        assert r.target == pytest.approx(float(wanted[r.source]))


def hash_of(key, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    data = f":{'' if key is None else key}:{inner}"
    return int(hashlib.md5(data.encode()).hexdigest()[:15], 16)


def naive(rows, weights=(1, 2, 3), most=3):
    """(id, size, source_size, target, taken) of (id, text, source)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = {}
    for (_, _, s), n in zip(rows, size):
        sizes[s] = sizes.get(s, 0) + n
    goal = naive_targets(sizes, weights, most) if rows else {}
    below, whole = {}, {}
    for s, n in sizes.items():
        whole[s] = int(goal[s] // n) if n else 0
        rest, ahead, below[s] = goal[s] - whole[s] * n, 0, 0
        held = {}
        for (k, t, src), n in zip(rows, size):
            if src == s:
                held[hash_of(k, t)] = held.get(hash_of(k, t), 0) + n
        for h in sorted(held) if rest > 0 else []:
            if ahead + held[h] > rest:
                below[s] = h + (rest - ahead > held[h] / 2)
                break
            ahead += held[h]
            below[s] = h + 1
    return sorted(
        (
            (k, n, sizes[s], round(float(goal[s]), 6), n * (whole[s] + (hash_of(k, t) < below[s])))
            for (k, t, s), n in zip(rows, size)
        ),
        key=str,
    )


def got(df):
    return sorted(
        ((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()),
        key=str,
    )


def test_given_documents(documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    assert got(mixing.mix_table(documents)) == naive(rows)


def test_edge_cases(edges, clashing, empty):
    rows = [(r.doc_id, r.text, r.source) for r in edges.collect()]
    for docs in (edges, clashing):
        assert got(mixing.mix_table(docs)) == naive(rows)
    assert mixing.mix_table(empty).count() == 0 and mixing.mix(empty).count() == 0


@pytest.mark.parametrize("bits", [4, 12, 60])
def test_width_of_levels_changes_nothing(documents, monkeypatch, bits):
    wanted = got(mixing.mix_table(documents))
    monkeypatch.setattr(mixing, "LEVEL_BITS", bits)
    assert got(mixing.mix_table(documents)) == wanted


def test_mixed_table_repeats_rows(clashing, documents):
    for docs in (clashing, documents):
        table = mixing.mix_table(docs).collect()
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns
        assert mixed.count() == sum(r.copies for r in table)


def test_budgets_are_nested(documents):
    rows = mixing.measured(documents, "doc_id", "text", "source")
    small = {r.source: r.whole * 2**60 + (r.below << r.shift) for r in mixing.thresholds(rows, (1,), 1).collect()}
    large = {r.source: r.whole * 2**60 + (r.below << r.shift) for r in mixing.thresholds(rows, (1,), 3).collect()}
    assert small.keys() == large.keys()
    assert isinstance(next(iter(rows.take(1))), Row)
