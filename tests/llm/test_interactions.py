"""The filter audit against plain loops over documents and orders."""

import random
import re
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
import pytest
from conftest import SCHEMA

from windspan.llm.interactions import audit, coalitions, failures, shapley_values

LETTERS = "ABCDE"
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
LABELS = "doc_id long, quality int, toxic int"


def failed(rows):
    """The filters that each of (id, text, part) fails."""
    out = []
    for id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = len(re.findall("[A-Z]", text))
        conditions = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * capitals > 10 * len(text),
            "D": bool(set("#$%&*|") & set(text)),
            "E": id is not None
            and any(i is not None and i < id and (t or "") == text for i, t, _ in rows),
        }
        out.append({letter for letter, fails in conditions.items() if fails})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = failed(rows)
    parts = {}
    for (id, _, part), f in zip(rows, fails):
        parts.setdefault(part or "", []).append((id, f))
    out = []
    for part, docs in parts.items():
        share = dict.fromkeys(LETTERS, 0)
        made = []
        for order in permutations(LETTERS):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                share[x] += len(gone)
                every = sum(x in f for _, f in docs)
                made.append(
                    [part, "".join(order), step, len(left), len(gone), every - len(gone)]
                    + [sum(f == {x} for _, f in docs)]
                    + [sum(i in s for i, _ in gone) for s in (good, toxic)]
                )
        out += [[*m, share[m[1][m[2] - 1]]] for m in made]
    columns = ["part", "filter_order", "step", *COUNTS]
    return pd.DataFrame(out, columns=columns)


def check(spark, docs, labels):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    made = audit(docs, spark.createDataFrame(labels, LABELS)).toPandas()
    want = brute(rows, labels)
    keys = ["part", "filter_order", "step"]
    pd.testing.assert_frame_equal(
        made.sort_values(keys, ignore_index=True)[want.columns],
        want.sort_values(keys, ignore_index=True),
        check_dtype=False,
    )
    return made


def test_defined_results(spark, edges, clashing):
    labels = [(1, 1, 0), (4, 0, 1), (6, 1, 1), (6, 0, 0), (7, 1, None), (99, 1, 1), (None, 1, 1)]
    made = check(spark, edges, labels)
    assert set(made.part) == {"", "de", "en"} and len(made) == 3 * 600
    again = audit(clashing, spark.createDataFrame(labels, LABELS)).toPandas()
    keys = ["part", "filter_order", "step"]
    pd.testing.assert_frame_equal(
        again.sort_values(keys, ignore_index=True), made.sort_values(keys, ignore_index=True)
    )


def test_against_loops(spark):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        words = [rng.choice("ab cd ef GH IJ # x%").strip() + str(rng.randrange(60)) for _ in range(rng.choice((5, 110)))]
        if rng.random() < 0.5:
            words = [f"w{k}" for k in range(len(words))]
        rows.append((rng.randrange(140), " ".join(words), rng.choice(("en", "de", None)), "s", 0))
    rows += [(200 + k, rows[k % 20][1], "en", "s", 0) for k in range(60)]  # copies
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 260, 2)]
    check(spark, spark.createDataFrame(rows, SCHEMA), labels)


def test_empty_tables(spark, edges, empty):
    none = spark.createDataFrame([], LABELS)
    assert audit(empty, none).count() == 0
    made = audit(edges, none).toPandas()
    assert (made[["good_lost", "toxic_lost"]] == 0).all().all()


def test_values_are_the_mean_over_orders():
    rng = random.Random(5)
    for n in range(1, 6):
        game = [0, *(rng.randrange(10**12) for _ in range((1 << n) - 1))]
        want = [Fraction(0)] * n
        for order in permutations(range(n)):
            s = 0
            for i in order:
                want[i] += Fraction(game[s | 1 << i] - game[s], factorial(n))
                s |= 1 << i
        assert shapley_values(game) == want


def test_coalitions_have_all_subsets(spark, edges):
    table = coalitions(failures(edges), spark.createDataFrame([], LABELS), 5).toPandas()
    assert table.groupby("part").size().eq(32).all()
    assert table[table.coalition == 0].removed.eq(0).all()


def test_other_filters(spark, edges):
    none = spark.createDataFrame([], LABELS)
    made = audit(edges, none, {"X": "size(words) = 0", "Y": "text like 'one%'"}, copies=None).toPandas()
    assert set(made.filter_order) == {"XY", "YX"}
    first = made[(made.part == "") & (made.filter_order == "XY") & (made.step == 1)]
    assert first.removed.tolist() == [3]
    with pytest.raises(ValueError):
        audit(edges, none, {"E": "true"})
