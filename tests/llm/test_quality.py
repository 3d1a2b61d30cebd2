"""Quality scores: held-out ranking, the isotonic fit, defined results."""

import zlib

import numpy as np
import pytest

from windspan.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == docs.count()
    good, bad = [], []
    for r in labels.collect():
        f = found[r.doc_id]
        assert f.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= f.score <= 1 and f.predicted == int(f.score >= 0.3)
        if f.held_out:
            (good if r.quality else bad).append(f.score)
    wins = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert wins > 0.85 and np.mean(np.array(good) >= 0.3) > 0.95


def test_isotonic():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 4000)
    y = (rng.uniform(0, 1, 4000) < (x + 1) / 2).astype(float)
    corners, chances = quality.isotonic(x, y, np.ones(4000))
    assert (np.diff(corners) > 0).all() and (np.diff(chances) >= 0).all()
    assert np.interp([-0.5, 0, 0.5], corners, chances) == pytest.approx([0.25, 0.5, 0.75], abs=0.08)
    # weights count like repeated rows
    once = quality.isotonic(np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.array([3.0, 1.0]))
    assert once[1][0] == pytest.approx((0 + 0.25 * 2) / (3 + 2))


def test_every_block_counts():
    text = b"x" * 1300
    assert [len(b) for b in quality.blocks(text)] == [512, 512, 276]
    assert quality.blocks(b"") == [b""]


@pytest.mark.parametrize("rows, score", [([], 0.5), ([(6, 1, 0), (8, 1, 0)], 1.0), ([(6, 0, 0)], 0.0)])
def test_labels_of_one_kind(spark, edges, rows, score):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    held = {6: zlib.crc32(b"6") % 5, 8: zlib.crc32(b"8") % 5}
    rows = [r for r in rows if held[r[0]]]
    found = quality.classify(edges, labels).collect()
    assert len(found) == edges.count()
    assert {r.score for r in found} == {score if rows else 0.5}


def test_edge_cases(spark, edges, clashing, empty):
    labels = spark.createDataFrame(
        [(i, q, 0) for i in [*range(9), None] for q in (0, 1, None)],
        "doc_id long, quality int, toxic int",
    )
    for docs in (edges, clashing):
        found = quality.classify(docs, labels).collect()
        assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(edges, labels.limit(0)).count() == edges.count()
