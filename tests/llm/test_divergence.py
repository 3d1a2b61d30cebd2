"""Source divergence against dense sums over all terms, in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from conftest import SCHEMA

from windspan.llm import divergence as d

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs=3, top=200):
    """From rows (lang, source, text)."""
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least_docs)
        mine = {s: c for (x, s), c in groups.items() if x == lang}

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // q

        whole = shares(sum(mine.values(), Counter()))
        by_source = {s: shares(c) for s, c in mine.items()}
        for s, p in by_source.items():
            pairs = [
                (t, sum(f(p[w], q[w]) for w in kept)) for t, q in by_source.items() if t != s
            ]
            terms = [
                (w, f(p[w], whole[w])) for w in kept if mine[s][w] > 0 and p[w] > whole[w]
            ]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found[:limit], 1)]
    return pd.DataFrame(out, columns=COLUMNS)


def same(made, want):
    keys = ["lang", "source", "part", "rank"]
    pd.testing.assert_frame_equal(
        made.toPandas().sort_values(keys, ignore_index=True)[COLUMNS],
        want.sort_values(keys, ignore_index=True),
        check_dtype=False,
    )


def table(n, sources, seed=3):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(65 + i // 26)}" for i in range(80)]
    rows = []
    for _ in range(n):
        source = rng.choice(sources)
        few = words[: 10 + hash(source or "") % 7 * 10] if rng.random() < 0.7 else words
        text = rng.choice(" -0\n").join(rng.choice(few) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(("en", "de", None)), source, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, s, 0) for i, (lang, s, t) in enumerate(rows)], SCHEMA
    )


def test_defined_results(spark, edges, clashing, empty):
    rows = [(r.lang, r.source, r.text) for r in edges.collect()]
    for least in (1, 3):
        same(d.divergence(edges, least_docs=least, top=5), brute(rows, least, 5))
    same(d.divergence(clashing, least_docs=1), brute(rows, 1))
    assert d.divergence(empty).count() == 0


def test_against_dense_sums(spark):
    rows = table(400, ["a", "b", "ä", None, "z" * 30, "lone"])
    rows += [("fr", "x", "..."), ("fr", "y", "42"), ("it", "only", "uno due uno")] * 3
    same(d.divergence(frame(spark, rows)), brute(rows))


def test_many_sources_and_copies(spark):
    rows = table(300, [f"s{i}" for i in range(40)], seed=8) + [("en", "hot", "same text here")] * 900
    same(d.divergence(frame(spark, rows), top=3), brute(rows, top=3))


def test_blocks_of_groups_give_the_same_sums(monkeypatch):
    """A task that holds one group's accumulator at a time, against one that holds all."""
    rng = np.random.default_rng(4)
    peers, entries = 7, []
    for term in range(60):
        for group in sorted(rng.choice(peers, rng.integers(1, peers + 1), replace=False)):
            entries.append((f"t{term:02}", int(group), int(rng.integers(10**6, 10**9))))

    def run(blocks):
        rows = [
            ("en", b, t, g, peers, p, 1000 + g) for b in range(blocks) for t, g, p in entries
        ]
        names = ["lang", "block", "term", "group", "peers", "p", "z"]
        frame = pd.DataFrame(rows, columns=names)
        batches = [
            pa.RecordBatch.from_pandas(frame.iloc[i : i + 37], preserve_index=False)
            for i in range(0, len(frame), 37)
        ]
        made = [r for b in d._scatter_batches(iter(batches)) for r in b.to_pylist()]
        return sorted((r["a"], r["b"], r["value"]) for r in made)

    whole = run(1)
    by_term = defaultdict(dict)
    for t, g, p in entries:
        by_term[t][g] = p

    def f(p, q):
        return (p - q) ** 2 // q

    want = defaultdict(int)
    for found in by_term.values():
        for a, p in found.items():
            for b, q in found.items():
                za, zb = 1000 + a, 1000 + b
                want[a, b] += f(p, q) - f(p, zb) - f(za, q) + f(za, zb)
    assert whole == sorted((a, b, v) for (a, b), v in want.items() if v)
    monkeypatch.setattr(d, "CELLS", 2 * peers)  # two groups to a block
    assert run(4) == whole


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Alpha beta, " * 50 + "x" * 100 + " end").encode()
    whole = text.translate(d.TERMS).split()
    monkeypatch.setattr(d, "PIECE", 16)
    assert [w for part in d._pieces(text.translate(d.TERMS)) for w in part] == whole


def test_counts_are_passed_on_in_parts(monkeypatch):
    monkeypatch.setattr(d, "ENTRIES", 5)
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(["en"] * 4),
            pa.array(["s"] * 4),
            pa.array([b"a b c d e f", b"a a", b"", b"A"], pa.binary()),
        ],
        names=["lang", "source", "text"],
    )
    made = pd.concat([b.to_pandas() for b in d._count_batches(iter([batch]))])
    sums = made.groupby("term", dropna=False)[["n", "docs"]].sum()
    assert sums.loc["a"].tolist() == [4, 3] and len(sums) == 7
