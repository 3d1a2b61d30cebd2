"""Benchmark templates: exact and re-parameterised questions, and what is none."""

import pytest

from windspan.llm import decontam

QUESTION = (
    "A train leaves the city at 9 and travels 120 km to the coast with Maria on board. "
    "If it stops for 15 minutes on the way and Maria walks 3 km, when does it arrive?"
)
CHANGED = (
    "A train leaves the city at 7 and travels 345 km to the coast with Pedro on board. "
    "If it stops for 20 minutes on the way and Pedro walks 8 km, when does it arrive?"
)
#: The second name is another one, so the parameters do not fit.
MIXED = CHANGED.replace("Pedro walks", "Anna walks").replace("9", "7")
FILLER = "Some words of prose that nobody asked about stand around here. "


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, QUESTION), (1, QUESTION), (2, None), (3, ""), (4, "too short"), (None, FILLER * 2)]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' as hash")


def found(spark, items, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontam.leaks(docs, items.filter("item_id is not null")).collect()
    return {(r.doc_id, r.item_id): r.kind for r in rows}


def test_kinds(spark, items):
    inside = "Before it. " + FILLER * 30 + "{} " + FILLER * 30
    assert found(
        spark,
        items,
        inside.format(QUESTION),
        inside.format(CHANGED),
        inside.format(MIXED),
        FILLER * 60,
        QUESTION.replace(" ", "*** \n"),
        " ".join(QUESTION.split()[:8]),
        " ".join(QUESTION.split()[5:25]),
        None,
        "",
    ) == {(0, 1): "exact", (1, 1): "reparameterised", (4, 1): "exact", (6, 1): "exact"}


def test_slots_must_map_one_to_one(spark, items):
    # two different numbers become one
    assert found(spark, items, CHANGED.replace("20 minutes", "345 minutes")) == {}
    # the far end of a very long document counts
    assert found(spark, items, FILLER * 3_000 + CHANGED) == {(0, 1): "reparameterised"}


def naive(docs, items, window=8):
    """Pairs with an item's window of equal words."""
    where = {}
    for r in items.collect():
        words = r.text.split()
        for i in range(len(words) - window + 1):
            where.setdefault(tuple(words[i : i + window]), set()).add(r.item_id)
    pairs = set()
    for r in docs.collect():
        words = r.text.split()
        for i in range(len(words) - window + 1):
            pairs |= {(r.doc_id, k) for k in where.get(tuple(words[i : i + window]), ())}
    return pairs


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_passages(spark, sf):
    docs, items = (
        spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "benchmark")
    )
    rows = decontam.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == naive(docs, items)
    gone = {r.doc_id for r in rows}
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - gone


def test_without_broadcast(documents, spark, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    wanted = decontam.leaks(documents, items).collect()
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(decontam.leaks(documents, items).collect()) == sorted(wanted)


def test_edge_cases(edges, clashing, empty, items):
    for docs in (edges, clashing):
        assert decontam.leaks(docs, items).count() == 0
        kept = decontam.clean(docs, items)
        assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontam.leaks(empty, items).count() == 0
    assert decontam.clean(empty, items).count() == 0
    assert decontam.leaks(edges, items.limit(0)).count() == 0
    assert decontam.clean(clashing, items.limit(0)).count() == clashing.count()


def test_null_and_repeated_ids(spark, items):
    rows = [(None, FILLER * 2), (5, QUESTION), (5, QUESTION), (5, "clean text under the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert found == {(None, None), (5, 1)}
    assert [r.text for r in decontam.clean(docs, items).collect()] == ["clean text under the same id"]


def changed(spark, item, *texts):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    return found(spark, items, *texts)


def test_each_occurrence_by_itself(spark, items):
    other = CHANGED.replace("7", "6").replace("345", "99")
    stray = "Nobody knows why: a train leaves the city at 4 and travels 55 km to the sea."
    longer = CHANGED.replace("Pedro on board", "Pedro Ruiz on board")
    texts = (CHANGED + " " + other, stray + " " + FILLER * 9 + CHANGED, longer)
    assert found(spark, items, *texts) == {(i, 1): "reparameterised" for i in range(3)}


def test_item_that_repeats_its_template(spark):
    item = "Now please add 3 apples to the big blue bowl. Now please add 5 apples to the big blue bowl."
    text = item.replace("3", "7").replace("5", "8")
    assert changed(spark, item, text) == {(0, 1): "reparameterised"}


def test_units_in_other_number(spark):
    item = "The baker rests the dough for 1 hour and then bakes it for 2 hours in the old oven."
    text = item.replace("1 hour", "3 hours").replace("2 hours", "4 hours")
    assert changed(spark, item, text) == {(0, 1): "reparameterised"}


@pytest.mark.parametrize(
    "item",
    [
        "What is 12 + 45 + 78?",
        "Add 12 34 56 78 90 11 22 33 44 55",
        "Der Hund von Hans und Grete jagt Katze Maus Igel Fuchs Dachs Biber am Bach",
        "小明有三个苹果他又买了五个苹果请问他一共有多少个苹果",
        "แม่ซื้อส้มสามผลและกล้วยห้าผลรวมกันได้กี่ผล",
    ],
)
def test_word_for_word_whatever_the_words(spark, item):
    texts = [FILLER + f"{t} " + FILLER for t in (item, item.lower(), item.title())]
    texts.append("这是" + item + "吗")
    wanted = {(i, 1): "exact" for i in range(3 + (item[0] > "z"))}
    got = changed(spark, item, *texts)
    assert {k: v for k, v in got.items() if k in wanted} == wanted
    assert changed(spark, item, FILLER * 9) == {}


def test_copies_in_other_case(spark, items):
    plain = QUESTION.replace(".", "")
    texts = (QUESTION.lower(), QUESTION.title(), QUESTION.upper(), plain)
    assert found(spark, items, *texts) == {(i, 1): "exact" for i in range(4)}


def test_short_and_number_heavy_items_with_other_numbers(spark):
    cases = [
        ("What is 12 + 45 + 78?", "What is 7 + 31 + 99?"),
        ("Solve 3 x + 5 = 20", "Solve 4 x + 9 = 61"),
        ("Add 12 34 56 78 90 11 22 33 44 55", "Add 10 30 50 70 91 12 23 35 46 57"),
    ]
    for item, text in cases:
        got = changed(spark, item, f"{FILLER} {text} {FILLER}", FILLER * 3, "What is 3 for you and me")
        assert got == {(0, 1): "reparameterised"}, item


def test_one_common_window_is_no_leak(spark):
    """A pattern of articles and names, shared by an item of 16 tokens and a clean text."""
    item = "Gestern ging der Hans mit der Grete und dem Otto lange durch den dunklen grünen Wald spazieren"
    text = "Sie sahen der Hund mit der Leine und dem Ball zu, und niemand sonst war an jenem Tag dort."
    assert changed(spark, item, FILLER + text) == {}


def other_numbers(text):
    import re

    made = re.sub(r"[0-9]+", lambda m: str(int(m[0]) * 7 + 13), text)
    return made


def test_changed_copies_of_every_item(spark, sf_dir):
    """Every item of the given benchmark with a number in every sixth word's place and names changed."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    originals, copies = [], []
    for r in items:
        words = r.text.split()
        a = [str(11 + i) if i % 6 == 3 else w for i, w in enumerate(words)]
        b = [other_numbers(w) if i % 6 == 3 else w for i, w in enumerate(a)]
        originals.append((r.item_id, " ".join(a)))
        copies.append((r.item_id, f"{FILLER} {' '.join(b)} {FILLER}"))
    bench = spark.createDataFrame(originals, "item_id long, text string")
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    wanted = {(i, i) for i, _ in originals}
    assert len(got & wanted) >= 0.9 * len(wanted)
    assert len(got - wanted) <= 0.05 * len(wanted)


def test_a_repeated_template_is_bounded_work(spark):
    """An item of 360 tokens that repeats its template and a document of 5,000 words that does."""
    import time

    line = "Row {} of the long table holds {} kg for Maria "
    item = "".join(line.format(i, 2 * i + 1) for i in range(36))
    text = "".join(line.format(i + 500, 3 * i + 7) for i in range(500))
    start = time.perf_counter()
    found = changed(spark, item, text)
    assert time.perf_counter() - start < 60
    assert found in ({}, {(0, 1): "reparameterised"})
