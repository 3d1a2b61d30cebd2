"""Hilbert shards: the curve, equal counts, gapless slots, pruning."""

import zlib
from itertools import pairwise, product

import pytest

from windspan.llm import sharding


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    """Each step along the curve goes to a cell that differs by one in one dimension."""
    names = [f"d{i}" for i in range(dims)]
    cells = list(product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"{n} int" for n in names))
    found = sharding.hilbert_index(df, names, bits, "place").orderBy("place").collect()
    assert [r.place for r in found] == list(range(len(cells)))
    for a, b in pairwise(found):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


def check(docs, found, shards):
    rows = sorted(
        (
            (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
            for r in docs.collect()
        ),
        key=str,
    )
    made = found.collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in made), key=str) == rows
    slots = {}
    for r in made:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_given_documents(documents, shards):
    check(documents, sharding.assign(documents, shards), shards)


def test_reruns_agree(documents):
    one, two = (sharding.assign(documents).select("doc_id", "shard", "slot") for _ in range(2))
    assert one.exceptAll(two).count() == 0


def test_edge_cases(spark, edges, empty):
    check(edges, sharding.assign(edges, 8), 8)
    extra = edges.selectExpr("*", "'x' as place", "'x' as cell", "'x' as part", "0 as shard")
    found = sharding.assign(extra, 8)
    assert len(set(found.columns)) == len(found.columns)
    check(edges, found, 8)
    assert sharding.assign(empty).count() == 0
    same = spark.createDataFrame([(i, "copy", "en", "s") for i in range(100)], "doc_id long, text string, lang string, source string")
    check(same, sharding.assign(same, 8), 8)


def test_filters_skip_shards(documents):
    found = sharding.assign(documents, 8)
    sizes = found.groupBy("shard").agg({"size": "min"}).collect()
    assert min(r[1] for r in sizes) < max(r[1] for r in sizes) / 2
    langs = found.select("shard", "lang").distinct().groupBy("lang").count().collect()
    assert min(r["count"] for r in langs) <= 5


def test_too_many_cells(documents):
    with pytest.raises(ValueError):
        sharding.assign(documents, bits=5)
