"""SimHash near-duplicates against all pairs."""

import random

import pytest
import xxhash

from windspan.llm import simhash
from windspan.llm.components import component_labels
from windspan.session import setting


def naive_fingerprint(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").split(" ") if w]
    pieces = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def naive_components(rows, k=2):
    """component id of each (id, fingerprint), by all pairs."""
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= k:
                group[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(rows))]


def check(docs, **options):
    rows = [(r.doc_id, naive_fingerprint(r.text)) for r in docs.collect()]
    expected = sorted(
        zip(*[iter(rows)], naive_components(rows)), key=str
    )
    expected = sorted(((k, f"{f:016x}", c) for ((k, f), c) in expected), key=str)
    found = simhash.near_duplicates(docs, **options).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == expected


def test_given_documents(documents):
    check(documents)


def test_edge_cases(edges, clashing, empty):
    check(edges)
    check(clashing)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.representatives(empty).count() == 0


@pytest.mark.parametrize("dense", [2, 5, 256])
def test_links_of_crowded_fingerprints(spark, dense):
    """Many fingerprints near one another: pairs or stars, the components are the same."""
    rng = random.Random(dense)
    values = set()
    for centre in (rng.getrandbits(64) for _ in range(4)):
        for _ in range(80):
            x = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    edges = simhash.links(nodes, 2, dense)
    mask = (1 << 64) - 1
    for a, b in edges.collect():
        assert a < b and bin((a ^ b) & mask).count("1") <= 2
    root = {r.node: r.root for r in component_labels(edges, "a", "b").collect()}
    group = naive_components([(i, v) for i, v in enumerate(values)])
    found, wanted = {}, {}
    for v, g in zip(values, group):
        found.setdefault(root.get(simhash._signed(v), simhash._signed(v)), set()).add(v)
        wanted.setdefault(g, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_representatives(documents, clashing):
    kept = simhash.representatives(documents)
    found = simhash.near_duplicates(documents).collect()
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(
        {r.component_id for r in found}
    )
    # one row per component, though ids repeat and are null
    kept = simhash.representatives(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (False, 9)]


def test_representatives_shuffle_texts_once(spark, documents):
    """One exchange for the rows and one for the chosen keys, though neither side is broadcast."""
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = simhash.representatives(documents)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2


def test_null_ids_of_different_texts_stay(spark):
    rows = [(None, "red green blue yellow"), (None, "un deux trois quatre cinq"), (None, None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    assert simhash.representatives(docs).count() == 3


def test_long_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    labels = component_labels(chain, "a", "b").collect()
    assert len(labels) == 301 and {r.root for r in labels} == {0}


LONG_A = "one text that has quite a few words in it and is kept whole by every stage"
LONG_B = "something else entirely which nobody would take for a copy of any other line here"


def test_unlike_texts_under_one_id_are_kept(spark):
    """No text goes unless its component keeps one."""
    rows = [(3, LONG_A), (5, LONG_A), (5, LONG_B), (7, LONG_B + " x"), (7, "alone under seven"), (7, LONG_A)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = sorted((r.doc_id, r.text) for r in simhash.representatives(docs).collect())
    fps = {t: simhash.fingerprint(t.encode(), 3) for _, t in rows}
    components = []
    for t in fps:
        near = [c for c in components if any(bin((fps[t] ^ fps[u]) & (2**64 - 1)).count("1") <= 2 for u in c)]
        components = [c for c in components if c not in near] + [{t}.union(*near)]
    assert len(made) == len(components)
    for c in components:
        assert len([t for _, t in made if t in c]) == 1
    assert (3, LONG_A) in made


def test_rows_with_maps_and_null_ids(spark):
    rows = [
        (None, LONG_A, {"a": 1}, "x"),
        (None, LONG_A, {"a": 2}, "x"),
        (4, LONG_B, {"b": 1}, "y"),
        (4, LONG_B, {"b": 0}, "y"),
        (9, LONG_B, {}, None),
        (None, None, None, None),
        (2, "", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, `__key` string")
    made = simhash.representatives(docs)
    assert made.columns == docs.columns
    got = sorted([(r.doc_id, r.text, r.tags) for r in made.collect()], key=str)
    assert got == sorted([(2, "", None), (4, LONG_B, {"b": 0}), (None, LONG_A, {"a": 1})], key=str)
