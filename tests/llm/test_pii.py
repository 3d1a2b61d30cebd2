"""Pseudonyms: permutations, formats, links across documents, and the way back."""

import re

import pytest
from hypothesis import given, settings, strategies as st

from windspan.llm import pii

KEY = b"0123456789abcdef-test"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    image = [pii.feistel(x, n, KEY, "k") for x in range(n)]
    assert sorted(image) == list(range(n))
    assert [pii.feistel(y, n, KEY, "k", inverse=True) for y in image] == list(range(n))


VALUES = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (017) 555-7713", "+44 20 7946 0958", "555-123-4567"],
    "ip": ["97.51.17.173", "10.0.0.1"],
    "date": ["2024-02-29", "31.12.1999", "12/31/1999", "25/12/1999", "1850-05-06"],
    "email": ["und.34@mail7.example.com", "A_b+c@x-y.org"],
    "secret": ["token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "password: 'Hunter2-Hunter2'"],
}


@pytest.mark.parametrize("kind, value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_format_kept(kind, value):
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, restore=True)
    text = f"Before {value}, after."
    changed, kinds = there.apply(text)
    assert kinds == [kind] and changed != text
    assert changed.startswith("Before ") and changed.endswith(", after.")
    if kind not in ("ip",):  # addresses keep dots, not lengths
        assert re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", changed))) == re.sub(
            r"\d", "9", re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", text))
        ) or kind == "secret"
    assert back.apply(changed)[0] == text
    assert there.apply(f"Elsewhere {value}")[0][10:] == changed[7:-8]


@pytest.mark.parametrize(
    "text",
    [
        "9807915762804490",  # fails the Luhn check
        "0000000000000000",
        "GB82 WEST 1234 5698 7654 33",
        "666-12-1234",
        "256.1.1.1",
        "version 4.0.1",
        "2023-02-30",
        "31/31/2020",
        "CC BY-NC 4.0.",
        "12345",
        "",
        "no values here",
    ],
)
def test_left_alone(text):
    assert pii.Pseudonyms(KEY).apply(text) == (text, [])


def test_same_number_in_other_punctuation_stays_linked():
    names = pii.Pseudonyms(KEY)
    plain, spaced = (names.apply(v)[0] for v in ("4111111111111111", "4111 1111 1111 1111"))
    assert plain == spaced.replace(" ", "")


def test_keys_differ():
    assert pii.Pseudonyms(KEY).apply("10.0.0.1") != pii.Pseudonyms(KEY + b"x").apply("10.0.0.1")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab01 .@-/+()\n", max_size=60))
def test_round_trip_of_any_text(text):
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, restore=True)
    assert back.apply(there.apply(text)[0])[0] == text


def test_tables(documents, clashing, empty):
    made = pii.pseudonymised(documents, KEY)
    assert made.columns == [*documents.columns, "n_values", "kinds"]
    restored = pii.pseudonymised(made.drop("n_values", "kinds"), KEY, restore=True)
    assert restored.select("doc_id", "text").exceptAll(documents.select("doc_id", "text")).count() == 0
    names = pii.Pseudonyms(KEY)
    for r in made.join(documents.selectExpr("doc_id", "text as was"), "doc_id").collect():
        text, kinds = names.apply(r.was)
        assert (r.text, r.n_values, r.kinds) == (text, len(kinds), ",".join(sorted(set(kinds))))
    found = pii.pseudonymised(clashing, KEY)
    assert found.count() == clashing.count() and found.filter("text is null").count() == 2
    assert pii.pseudonymised(empty, KEY).count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymised(documents, b"short")


JWT = "eyJhbGciOiJIUzI1NiJ9." + "aB3" * 400 + ".x_-Y"


@pytest.mark.parametrize(
    "kind, value, behind",
    [
        ("iban", "AT61 1904 3002 3457 3201", " BIC"),
        ("iban", "BE68 5390 0754 7034", " EUR"),
        ("iban", "ES91 2100 0418 4502 0005 1332", " 2024"),
        ("iban", "DE89 3704 0044 0532 0130 00", " EUR 2024"),
        ("date", "2024-01-31", "T12:00:00Z"),
        ("date", "2024-01-31", "T120000"),
        ("secret", JWT, "'"),
        ("secret", "c2VjcmV0IHZhbHVlcw==", "'"),
    ],
)
def test_values_with_something_behind(kind, value, behind):
    before = "token = '" if kind == "secret" else "On "
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, restore=True)
    changed, kinds = there.apply(before + value + behind)
    assert kinds == [kind] and value not in changed
    assert changed.startswith(before) and changed.endswith(behind)
    assert len(changed) == len(before + value + behind)
    assert back.apply(changed)[0] == before + value + behind


def test_value_within_a_match_that_fails():
    assert pii.Pseudonyms(KEY).apply("AB12 4111 1111 1111 1111")[1] == ["card"]


@pytest.mark.parametrize("day", ["2021-03-26", "2021-03-05", "1999-12-31", "1850-05-06", "2000-02-29"])
def test_one_day_in_every_format_is_one_pseudonym(day):
    y, m, d = day.split("-")
    spelled = [f"{y}-{m}-{d}", f"{y}/{m}/{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}"]
    spelled += [f"{d}/{m}/{y}"] if int(d) > 12 else []
    names, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, restore=True)
    made = [names.apply(s)[0] for s in spelled]
    days = {pii._dates(s)[0] for s in made}
    assert len(days) == 1 and days != {pii._dates(day)[0]}
    assert [back.apply(s)[0] for s in made] == spelled
