"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Numbers and dates that pass their check (Luhn, mod 97, octet, area and calendar rules) and
addresses are replaced by others of the same format that pass it too. Each kind is numbered from 0
to n - 1, the number is permuted by a Feistel network keyed with `key` and the kind, and written back
into the original's punctuation. Equal values get equal pseudonyms in every document, different
values different ones, and the key's owner can undo it.

| Kind | Kept | Permuted |
| card | separators | all digits but the last, which becomes the check digit |
| iban | country, letters, spaces | digits; check digits follow |
| ssn | dashes | area, group and serial within their rules |
| phone | country code, punctuation | the other digits |
| ip | dots | the 32-bit address |
| date | order and separators | the day, within 1900 to 2099, or 1 to 9999 for days outside |
| email | domain, punctuation, case of letters | letters and digits of the local part |
| secret | name, quotes, case of letters | letters and digits of an assigned token or password |

Defined results
    null text            null, no values
    empty text           empty, no values
    repeated rows, null ids, empty table, other columns   row by row; other columns are kept by
                         `pseudonymised` and may have any names but those it adds
Text before, between and after the values is not touched.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import isqrt, prod

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
REMEMBERED = 100_000  # pseudonyms that a worker keeps


def feistel(x: int, n: int, key: bytes, kind: str, inverse: bool = False) -> int:
    """A permutation of 0 .. n - 1: an alternating Feistel network over a rectangle of at least n
    cells, walked until it comes back below n."""
    a = isqrt(n - 1) + 1
    b = -(-n // a)

    def mixed(step: int, half: int) -> int:
        data = b"%d|%d|%d" % (step, n, half)
        size = (max(a, b).bit_length() + 7) // 8 + 8
        return int.from_bytes(blake2b(data, key=key, person=kind.encode()[:16], digest_size=min(64, size)).digest())

    while True:
        left, right = divmod(x, b)
        for step in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if step % 2 == 0:
                left = (left + sign * mixed(step, right)) % a
            else:
                right = (right + sign * mixed(step, left)) % b
        x = left * b + right
        if x < n:
            return x


# Checks and numberings of the kinds. `permute(x, n)` is the keyed permutation of the kind.

Permute = Callable[[int, int], int]


def luhn_digit(digits: str) -> str:
    """The digit that makes `digits` and it pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 else sum(divmod(2 * int(d), 10))
    return str(-total % 10)


def _refilled(pattern: str, digits: str) -> str:
    """`pattern` with its digits replaced in turn."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


def _digits(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


def _number(digits: str, permute: Permute) -> str:
    return str(permute(int(digits), 10 ** len(digits))).zfill(len(digits))


def _card(value: str, permute: Permute) -> str | None:
    digits = _digits(value)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    # Numbers of one repeated digit are no cards; the walk passes over them.
    body = _number(digits[:-1], permute)
    while len(set(body + luhn_digit(body))) == 1:
        body = _number(body, permute)
    return _refilled(value, body + luhn_digit(body))


def _mod97(country: str, check: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + check)) % 97


def _iban(value: str, permute: Permute) -> str | None:
    plain = value.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _mod97(country, check, rest) != 1:
        return None
    if not (digits := _digits(rest)):
        return None
    rest = _refilled(rest, _number(digits, permute))
    check = str(98 - _mod97(country, "00", rest)).zfill(2)
    left = iter(country + check + rest)
    return "".join(c if c == " " else next(left) for c in value)


def _ssn(value: str, permute: Permute) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(permute(at, 898 * 99 * 9999), 9999)
    area, group = divmod(rest, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(value: str, permute: Permute) -> str | None:
    groups = re.findall(r"[0-9]+", value)
    kept = groups[0] if value.startswith("+") or len(groups[0]) < 3 else ""
    digits = _digits(value)
    if not 8 <= len(digits) <= 15:
        return None
    return _refilled(value, kept + _number(digits[len(kept) :], permute))


def _ip(value: str, permute: Permute) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    at = permute(int.from_bytes(bytes(map(int, parts))), 1 << 32)
    return ".".join(map(str, at.to_bytes(4)))


def _dates(value: str) -> tuple[dt.date, str] | None:
    """The day, and the order of its parts."""
    a, b, c = map(int, re.findall(r"[0-9]+", value))
    first = re.search(r"[^0-9]", value)[0]
    if len(value.split(first)[0]) == 4:
        order, ymd = "ymd", (a, b, c)
    elif first == "/" and a <= 12:
        order, ymd = "mdy", (c, a, b)
    elif first == "/":
        order, ymd = "late", (c, b, a)  # day first, as the day is no month
    else:
        order, ymd = "dmy", (c, b, a)
    try:
        return dt.date(*ymd), order
    except ValueError:
        return None


def _date(value: str, permute: Permute) -> str | None:
    if (found := _dates(value)) is None:
        return None
    day, order = found
    low, high = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
    inside = low <= day <= high
    if not inside:
        low, high = dt.date(1, 1, 1), dt.date(9999, 12, 31)
    first, n, at = low.toordinal(), high.toordinal() - low.toordinal() + 1, day.toordinal()
    # Days that could be months stay such days, so that a day is one pseudonym in every order of its
    # parts and the order can be told again.
    month_like = day.day <= 12
    while True:
        at = first + permute(at - first, n)
        day = dt.date.fromordinal(at)
        if (day.day <= 12) == month_like and (inside or not 1900 <= day.year <= 2099):
            break
    y, m, d = f"{day.year:04d}", f"{day.month:02d}", f"{day.day:02d}"
    parts = {"ymd": y + m + d, "mdy": m + d + y, "late": d + m + y, "dmy": d + m + y}[order]
    return _refilled(value, parts)


def _mixed(value: str, permute: Permute) -> str:
    """Lower-case letters, upper-case letters and digits permuted, each within its class."""
    classes = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
    own = [next((k for k in classes if c in k), None) for c in value]
    n, at = prod(len(k) for k in own if k), 0
    for c, k in zip(value, own):
        at = at * len(k) + k.index(c) if k else at
    at, made = permute(at, n), []
    for c, k in zip(reversed(value), reversed(own)):
        if k:
            at, i = divmod(at, len(k))
            c = k[i]
        made.append(c)
    return "".join(reversed(made))


def _email(value: str, permute: Permute) -> str:
    local, at, domain = value.rpartition("@")
    return _mixed(local, permute) + at + domain


_HEX = "0123456789abcdef"


def _secret(value: str, permute: Permute) -> str:
    # A hexadecimal token stays one.
    for digits in (_HEX, _HEX.upper()):
        if all(c in digits for c in value):
            made = permute(int(value, 16), 16 ** len(value))
            text = f"{made:0{len(value)}x}"
            return text if digits == _HEX else text.upper()
    return _mixed(value, permute)


KINDS: dict[str, tuple[str, Callable[[str, Permute], str | None]]] = {
    "email": (
        r"(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._+%-]{0,63})@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
        _email,
    ),
    "secret": (
        r"(?i:(?:token|secret|api[_-]?key|password|passwd)\s{0,3}[=:]\s{0,3}[\"'])"
        r"(?P<secret_value>[A-Za-z0-9+/_.-]{8,}={0,2})(?=[\"'])",
        _secret,
    ),
    "iban": (r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])", _iban),
    "ip": (r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\w)", _ip),
    "date": (
        r"(?<![\w./-])(?:[0-9]{4}(?P<date_s>[-/.])[0-9]{2}(?P=date_s)[0-9]{2}"
        r"|[0-9]{2}(?P<date_t>[-/.])[0-9]{2}(?P=date_t)[0-9]{4})(?=T[0-9]{2}(?::?[0-9]{2})|(?![\w/-]))",
        _date,
    ),
    "ssn": (r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    "phone": (
        r"(?<![\w+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w)"
        r"|(?<![\w+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?!\w)"
        r"|(?<![\w.-])[0-9]{3}(?P<phone_s>[ .-])[0-9]{3}(?P=phone_s)[0-9]{4}(?![\w-])",
        _phone,
    ),
    "card": (
        r"(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}(?P<card_s>[ -])[0-9]{4}(?P=card_s)[0-9]{4}(?P=card_s)"
        r"[0-9]{4}(?:(?P=card_s)[0-9]{3})?|[0-9]{4}(?P<card_t>[ -])[0-9]{6}(?P=card_t)[0-9]{5})(?![\w-])",
        _card,
    ),
}
# Letters of an IBAN by country; elsewhere all ends of a match are tried, the longest first.
IBAN_SIZES = {
    **dict.fromkeys("NO".split(), 15), **dict.fromkeys("BE".split(), 16),
    **dict.fromkeys("DK FI FO GL NL".split(), 18), **dict.fromkeys("MK SI".split(), 19),
    **dict.fromkeys("AT BA EE KZ LT LU XK".split(), 20), **dict.fromkeys("CH CR HR LI LV".split(), 21),
    **dict.fromkeys("BG BH DE GB GE IE ME RS".split(), 22), **dict.fromkeys("AE GI IL".split(), 23),
    **dict.fromkeys("AD CZ ES MD PK RO SA SE SK TN VA".split(), 24),
    **dict.fromkeys("LY PT ST".split(), 25), **dict.fromkeys("IS TR".split(), 26),
    **dict.fromkeys("FR GR IT MC MR SM".split(), 27), **dict.fromkeys("AL AZ CY DO GT HU LB PL".split(), 28),
}


def iban_ends(value: str) -> Iterator[str]:
    """`value` and its beginnings that end before a blank or have the country's length."""
    size, seen = IBAN_SIZES.get(value[:2]), 0
    ends = [len(value)]
    for i, c in enumerate(value):
        if c == " " and seen >= 15 and size is None:
            ends.append(i)
        seen += c != " "
        if seen == size and value[i + 1 : i + 2] in ("", " "):
            ends = [i + 1, *ends]
    return (value[:e] for e in (ends if size else sorted(ends, reverse=True)))


FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()))
HINT = re.compile(r"[0-9@]|[=:]\s{0,3}[\"']")


class Pseudonyms:
    """Replaces values with pseudonyms under `key`, or with `restore` the other way."""

    def __init__(self, key: bytes, restore: bool = False):
        self.key, self.inverse = key, restore
        self.of = lru_cache(REMEMBERED)(self._of)

    def _of(self, kind: str, value: str) -> str | None:
        def permute(x: int, n: int) -> int:
            return feistel(x, n, self.key, kind, self.inverse)

        return KINDS[kind][1](value, permute)

    def apply(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with pseudonyms, and the kinds of the values replaced."""
        if not text or not HINT.search(text):
            return text, []
        parts, kinds, at, start = [], [], 0, 0
        while m := FINDER.search(text, start):
            kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k])
            a, b = m.span("secret_value" if kind == "secret" else 0)
            tries = iban_ends(text[a:b]) if kind == "iban" else (text[a:b],)
            for value in tries:
                if (made := self.of(kind, value)) is not None:
                    parts += [text[at:a], made]
                    kinds.append(kind)
                    at = start = a + len(value)
                    break
            else:
                start = m.start() + 1  # a value may begin within
        return ("".join([*parts, text[at:]]), kinds) if kinds else (text, kinds)


def pseudonymised(
    docs: DataFrame, key: bytes, text: str = "text", restore: bool = False
) -> DataFrame:
    """`docs` with the text's values replaced, and n_values and kinds (sorted, comma-joined)."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the key has 16 to 64 bytes")

    @F.pandas_udf("text string, n_values int, kinds string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = Pseudonyms(key, restore)
        for batch in batches:
            rows = [names.apply(t) for t in batch]
            yield pd.DataFrame(
                {
                    "text": [t for t, _ in rows],
                    "n_values": [len(k) for _, k in rows],
                    "kinds": [",".join(sorted(set(k))) for _, k in rows],
                }
            )

    added = ("n_values", "kinds")
    own: list[Column] = [
        F.col("__pii.text").alias(c) if c == text else F.col(c)
        for c in docs.columns
        if c not in added
    ]
    return docs.withColumn("__pii", replaced(F.col(text))).select(
        *own, *[F.col(f"__pii.{c}").alias(c) for c in added]
    )
