"""Benchmark decontamination by templates, to catch questions with other numbers and names too.

Texts become template tokens: lower-case words, with numbers, units after numbers and capitalised
names within a sentence replaced by typed placeholders. Windows of `window` tokens are joined by
hash, and so are windows of the lower-case words themselves: those find copies with few literal words
or in other upper and lower case. Of scripts without blanks each letter is a token.

Items without a window of which half is literal, numbers in rows for the most part, are looked for
whole by their template, and so are items under `window` tokens; both need a literal word or two. Only
places that begin with two such items' first two tokens are looked at for that.

Each matched window says by how much the document's place is ahead of the item's, its line, and which
of the item's values stand for which of the document's, its slots. Windows of one line are an
occurrence; where tokens were put in or left out, so are those of lines within `window`, or within the
item's length, of one another, of which the line with most windows speaks for each place of the item.
The slots of an occurrence must map one to one, units without regard to number: then the item occurs,
word for word or with other parameters. Windows with the same values count without that check, and from
all occurrences together. Every step is a row for each matched window or less, grouped by item places,
so a document that repeats a template a thousand times is no more work a word than any other.

A document leaks an item if windows with the same values cover `run` tokens of it, or half of it; or if
an occurrence with other parameters covers `run` tokens of it, or all.

Defined results
    null or empty text          leaks nothing
    items without a token       are never found
    null ids                    are ids
    repeated rows or items      one row for each pair of ids
    one id with several texts   the text that covers most counts
    very long texts             whole; a row for each matched window
    empty tables                no rows
    other columns               not read by `leaks`, kept by `clean`; helpers start with `__`
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from windspan.llm.names import unused
from windspan.session import written

#: Scripts without blanks between words, of which each letter is a token: Thai, Lao, Myanmar, Khmer,
#: Han, Hiragana and Katakana, by their blocks, which are tested faster than scripts are.
UNSPACED = (
    r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3021-\u303B\u3041-\u30FF"
    r"\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA9E0-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF\uFF66-\uFF9F"
    r"\x{1AFF0}-\x{1B16F}\x{20000}-\x{3FFFF}"
)
SPACED = rf"A-Za-z[\p{{L}}&&[^{UNSPACED}]]"
TOKEN = (
    rf"[{SPACED}][{SPACED}\p{{M}}]*+|[\p{{L}}&&[{UNSPACED}]]\p{{M}}*+"
    r"|[0-9]++(?:[.,:][0-9]++)*+|[.!?]"
)
#: Units after numbers, in English, French, German and Spanish.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre "
    "metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram "
    "kilograms pound pounds ton tons ml cl dl l liter liters litre litres gallon gallons cup cups "
    "ms s sec min h hr second seconds minute minutes hour hours day days week weeks month months "
    "year years seconde secondes heure heures jour jours semaine semaines mois an ans sekunde "
    "sekunden stunde stunden tag tage woche wochen monat monate jahr jahre segundo segundos minuto "
    "minutos hora horas dia dias semana semanas mes meses dollar dollars euro euros cent cents usd "
    "eur percent degrees k c f hz khz mhz ghz w kw mw v a pa bar j kj cal kcal mph kmh"
).split()
#: Units whose plural is another word than their singular, to it.
SINGULARS = {
    "inches": "inch", "feet": "foot", "sekunden": "sekunde", "stunden": "stunde", "tage": "tag",
    "wochen": "woche", "monate": "monat", "jahre": "jahr", "meses": "mes",
} | {u + "s": u for u in UNITS if len(u) > 1 and u + "s" in UNITS}
BROADCAST_KEYS = 1_000_000  # documents of about 20 bytes
BROADCAST_ROWS = 2_000_000  # hashes of benchmark windows; more are joined by a shuffle
BROADCAST_PARTS = 100_000  # benchmark windows with their tokens, of about 400 bytes
STARTS = 5_000  # first pairs of items looked for whole that are spelled in the plan; else all places
HALF, FEW = 8, 4  # tokens from which one literal word will do for a whole item, and two


def _ends(token: Column) -> Column:
    """A full stop, exclamation or question mark: tokens begin with one of these, 0-9 or a letter."""
    return (token < "0") | ((token >= ":") & (token < "A"))


def _digit(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def _kind(raw: Column, t: Column, low: Column, i: Column, made) -> Column:
    """Of the token `t`, the `i`th of `raw`: `made` of its placeholder, or of None for the word itself.
    Most tokens are lower-case words, so these are told first."""
    before = F.get(raw, i - 1)  # null before the first
    name = (
        (F.substring(t, 1, 1) != F.substring(low, 1, 1))
        & (F.length(t) > 1)
        & (F.substring(t, 2, 1 << 30) == F.substring(low, 2, 1 << 30))
        & ~_ends(before)
    )
    return (
        F.when(_digit(t), made("<num>"))
        .when(_digit(before) & low.isin(*UNITS), made("<unit>"))
        .when(t == low, made(None))
        .when(name, made("<name>"))
        .otherwise(made(None))
    )


def _raw(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def with_tokens(df: DataFrame, text: str) -> DataFrame:
    """`df` with __tokens, an array of (kind, value): the placeholder, or else the lower-case word, and
    the lower-case word. Sentence ends only tell names from first words."""
    df = df.withColumn("__raw", _raw(text)).withColumn("__low", F.transform("__raw", F.lower))

    def token(t: Column, i: Column) -> Column:
        low = F.get("__low", i)
        kind = _kind(F.col("__raw"), t, low, i, lambda k: low if k is None else F.lit(k))
        return F.when(~_ends(t), F.struct(kind.alias("kind"), low.alias("value")))

    tokens = F.filter(F.transform("__raw", token), lambda x: x.isNotNull())
    return df.withColumn("__tokens", tokens).drop("__raw", "__low")


def with_token_hashes(df: DataFrame, text: str) -> DataFrame:
    """`df` with the hashes of __tokens' kinds and values as two arrays, __kinds and __values, without
    the words themselves, which cost most to hand on."""
    df = df.withColumn("__raw", _raw(text)).withColumn("__low", F.transform("__raw", F.lower))
    value = F.transform("__low", lambda t: F.when(~_ends(t), F.xxhash64(t)))
    df = df.withColumn("__value", value)

    def kind(t: Column, i: Column) -> Column:
        word = F.get("__value", i)
        made = _kind(
            F.col("__raw"), t, F.get("__low", i), i, lambda k: word if k is None else F.xxhash64(F.lit(k))
        )
        return F.when(~_ends(t), made)

    def whole(hashes: Column) -> Column:
        return F.filter(hashes, lambda h: h.isNotNull())

    df = df.withColumn("__kinds", whole(F.transform("__raw", kind)))
    return df.withColumn("__values", whole(F.col("__value"))).drop("__raw", "__low", "__value")


def _places(hashes: Column, width: int) -> Column:
    """Where windows of `width` tokens begin."""
    n = F.size(hashes)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def _window_hash(hashes: Column, i: Column, width: int) -> Column:
    """The hash of an array of `width` token hashes, which is that of its members one by one."""
    if width <= 16:
        return F.xxhash64(*[F.get(hashes, i + j) for j in range(width)])
    return F.xxhash64(F.slice(hashes, i + 1, width))


def _begins(starts: list[int] | None):
    """Whether an item looked for whole may begin at a place of __kinds and __values."""

    def test(i: Column) -> Column:
        if starts is None:
            return F.lit(True)
        pairs = (F.xxhash64(F.get(a, i), F.get(a, i + 1)) for a in ("__kinds", "__values"))
        return next(pairs).isin(starts) | next(pairs).isin(starts)

    return test


def _all_places(width: int, window: int, starts: list[int] | None) -> Column:
    places = _places(F.col("__values"), width)
    return places if width == window else F.filter(places, _begins(starts))


def _near_placeholders(width: int) -> Column:
    """Where windows of `width` tokens begin that hold a placeholder; the others are the same by
    template and by words."""
    n = F.size("__values")
    marks = F.filter(
        F.sequence(F.lit(0), n - 1), lambda p: F.get("__kinds", p) != F.get("__values", p)
    )
    around = F.transform(
        marks, lambda p: F.sequence(F.greatest(p - (width - 1), F.lit(0)), F.least(p, n - width))
    )
    found = F.array_distinct(F.flatten(around))
    return F.when(n >= width, found).otherwise(F.array().cast("array<int>"))


def scanned_hashes(window: int, whole: list[int], starts: list[int] | None) -> Column:
    """The hashes, by template and by words, of all windows of a document that items are looked for
    in, as one array."""

    def hashes(places: Column, name: str, width: int) -> Column:
        return F.transform(places, lambda i: _window_hash(F.col(name), i, width))

    parts = [
        hashes(_places(F.col("__values"), window), "__values", window),
        hashes(_near_placeholders(window), "__kinds", window),
    ]
    for width in whole:
        places = _all_places(width, window, starts)
        parts += [hashes(places, name, width) for name in ("__values", "__kinds")]
    return F.concat(*parts)


def placed_hashes(window: int, whole: list[int], starts: list[int] | None) -> Column:
    """(at, width, hash) of the same windows; by template only where that is not the words."""
    parts = []
    for width in [window, *whole]:
        places = _all_places(width, window, starts)

        def rows(name: str) -> Column:
            return F.transform(
                places,
                lambda i: F.struct(
                    i.alias("at"),
                    F.lit(width).alias("width"),
                    _window_hash(F.col(name), i, width).alias("hash"),
                ),
            )

        other = F.filter(
            rows("__kinds"), lambda w: w["hash"] != _window_hash(F.col("__values"), w["at"], width)
        )
        parts += [rows("__values"), other]
    return F.concat(*parts)


def benchmark_windows(items: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """One row for each window of each item that is looked for: (item_id, item_key, item_tokens, at,
    width, plain, start, tokens). `plain` is true of word for word, `tokens` has its (kind, value)."""
    # Written, as filters on what follows would be pushed below the tokens, where each of them
    # would look at the text anew.
    items = written(
        with_tokens(items.select(F.col(id).alias("item_id"), F.col(text).alias("t")), "t")
        .select("item_id", "__tokens")
        .distinct(),  # equal texts of one id once
        "bench-items",
    ).withColumns({"item_key": F.xxhash64("__tokens"), "n": F.size("__tokens")})

    def literals(tokens: Column) -> Column:
        return F.size(F.filter(tokens, lambda t: ~t["kind"].startswith("<")))

    starts = (
        F.when(F.col("n") >= window, F.sequence(F.lit(0), F.col("n") - window))
        .when(F.col("n") > 0, F.array(F.lit(0)))
        .otherwise(F.array().cast("array<int>"))
    )
    cut = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("at"), F.slice("__tokens", i + 1, F.least(F.lit(window), F.col("n"))).alias("tokens")
        ),
    )
    cut = items.withColumn("cut", cut)
    rich = F.filter("cut", lambda w: (literals(w["tokens"]) >= (window + 1) // 2) & (F.col("n") >= window))
    words = literals(F.col("__tokens"))
    enough = ((words >= 1) & (F.col("n") >= HALF)) | ((words >= 2) & (F.col("n") >= FEW))
    whole = F.when(
        enough & (F.size(rich) == 0),
        F.array(F.struct(F.lit(0).alias("at"), F.col("__tokens").alias("tokens"))),
    ).otherwise(F.array().cast("array<struct<at: int, tokens: array<struct<kind: string, value: string>>>>"))

    def of(found: Column, plain: bool) -> DataFrame:
        return cut.select(
            "item_id",
            "item_key",
            F.col("n").alias("item_tokens"),
            F.lit(plain).alias("plain"),
            F.inline(found),
        )

    made = of(F.col("cut"), True).unionByName(of(rich, False)).unionByName(of(whole, False))
    # A window without placeholders is the same by template and word for word.
    return made.filter(
        F.col("plain") | F.exists("tokens", lambda t: t["kind"].startswith("<"))
    ).withColumn("width", F.size("tokens"))


def _hashed(windows: DataFrame) -> DataFrame:
    """`windows` with their `hash`, and `starts`, those of the first two kinds and words."""

    def of(name: str, n: int | None = None) -> Column:
        tokens = F.col("tokens") if n is None else F.slice("tokens", 1, n)
        return F.xxhash64(F.transform(tokens, lambda t: F.xxhash64(t[name])))

    return windows.withColumns(
        {
            "hash": F.when(F.col("plain"), of("value")).otherwise(of("kind")),
            "starts": F.array(of("kind", 2), of("value", 2)),
        }
    )


def _singulars() -> Column:
    return F.create_map(*[F.lit(w) for pair in SINGULARS.items() for w in pair])


def _slots() -> Column:
    """(kind, a, b): the values in a window, of the item's `tokens` and the document's `found`."""

    def value(token: Column) -> Column:
        single = F.coalesce(F.element_at(_singulars(), token["value"]), token["value"])
        return F.when(token["kind"] == "<unit>", single).otherwise(token["value"])

    pairs = F.zip_with(
        "tokens",
        "found",
        lambda a, b: F.struct(a["kind"].alias("kind"), value(a).alias("a"), value(b).alias("b")),
    )
    return F.filter(pairs, lambda s: s["kind"].startswith("<"))


def _small(keys: DataFrame) -> DataFrame:
    """`keys` of documents, marked for broadcast if counted as few; else Spark shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def covered(windows: Column) -> Column:
    """Tokens that (at, width) windows, sorted, cover."""
    return F.aggregate(
        windows,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, w: F.struct(
            (acc["sum"] + F.greatest(w["at"] + w["width"] - F.greatest(acc["end"], w["at"]), F.lit(0))).alias("sum"),
            F.greatest(acc["end"], w["at"] + w["width"]).alias("end"),
        ),
        lambda acc: acc["sum"],
    )


OF = ["doc_id", "doc_key", "item_id", "item_key"]


def matched_windows(
    docs: DataFrame, items: DataFrame, id: str, text: str, item: str, item_text: str, window: int
) -> DataFrame:
    """(doc_id, doc_key, item_id, item_key, item_tokens, line, at, width, same, slots): a row for each
    pair of a document's window and an item's with the same template or the same words. The key of a
    document is a hash of its text."""
    windows = written(_hashed(benchmark_windows(items, item, item_text, window)), "bench-windows")
    other = windows.filter(F.col("width") != window)
    whole = sorted(r.width for r in other.select("width").distinct().collect())
    starts = None
    if whole and whole[0] > 1:
        pairs = other.select(F.explode("starts").alias("start")).distinct().limit(STARTS + 1)
        pairs = [r.start for r in pairs.collect()]
        starts = pairs if len(pairs) <= STARTS else None
    rows = docs.select(
        F.col(id).alias("doc_id"), F.xxhash64(F.col(text)).alias("doc_key"), F.col(text).alias("t")
    )

    # First which documents meet an item at all; only those are looked at with their tokens.
    hashes = windows.select("hash").distinct()
    if windows.count() <= BROADCAST_ROWS:
        hashes = F.broadcast(hashes)
    scanned = F.explode(scanned_hashes(window, whole, starts)).alias("hash")
    met = with_token_hashes(rows, "t").select("doc_id", "doc_key", scanned)
    met = met.join(hashes, "hash", "left_semi").select("doc_id", "doc_key").distinct()
    met = written(met, "bench-met").withColumnsRenamed({"doc_id": "d", "doc_key": "k"})
    same_doc = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_key") == F.col("k"))
    those = rows.join(_small(met), same_doc, "left_semi").dropDuplicates(["doc_id", "doc_key"])
    parts = windows.drop("starts").withColumnsRenamed({"at": "item_at", "width": "item_width"})
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    hashed = with_tokens(those, "t").withColumns(
        {
            f"__{name}s": F.transform("__tokens", lambda t: F.xxhash64(t[name]))
            for name in ("kind", "value")
        }
    )
    found = hashed.select(
        "doc_id", "doc_key", "__tokens", F.inline(placed_hashes(window, whole, starts))
    )
    found = found.withColumn("found", F.slice("__tokens", F.col("at") + 1, F.col("width")))
    found = found.drop("__tokens").withColumnRenamed("hash", "h")
    met_windows = found.join(parts, (F.col("h") == F.col("hash")) & (F.col("width") == F.col("item_width")))

    def part(tokens: str, name: str) -> Column:
        return F.transform(tokens, lambda t: t[name])

    same = part("tokens", "value") == part("found", "value")
    alike = part("tokens", "kind") == part("found", "kind")  # not the hashes alone
    return (
        met_windows.withColumn("same", same)
        .filter(F.when(F.col("plain"), F.col("same")).otherwise(alike))
        .select(
            *OF,
            "item_tokens",
            (F.col("at") - F.col("item_at")).alias("line"),
            F.col("item_at").alias("at"),
            "width",
            "same",
            F.when(F.col("same") & ~alike, F.array().cast("array<struct<kind: string, a: string, b: string>>"))
            .otherwise(_slots())
            .alias("slots"),
        )
    )


def _leaks(
    docs: DataFrame,
    items: DataFrame,
    id: str,
    text: str,
    item: str,
    item_text: str,
    window: int,
    run: int,
) -> DataFrame:
    """(doc_key, doc_id, item_id, ...) by document text: the key is id and text."""
    matched = matched_windows(docs, items, id, text, item, item_text, window)
    place = [*OF, "item_tokens", "line", "at", "width"]
    # By words and by template a window is one row.
    matched = matched.groupBy(*place).agg(F.max(F.struct("same", "slots")).alias("w")).select(*place, "w.*")
    of_line = Window.partitionBy(*OF, "line")  # at most a row for each place of the item
    matched = written(matched.withColumn("support", F.count("*").over(of_line)), "bench-matched")

    # Words alone, from all occurrences.
    spans = F.array_sort(F.collect_set(F.when(F.col("same"), F.struct("at", "width"))))
    alone = matched.groupBy(*OF, "item_tokens").agg(covered(spans).alias("same_covered"))

    def bands(width: Column, scope: int) -> list[Column]:
        """Each line lies in two bands twice as wide as `width`, and close lines share one."""
        band = F.floor(F.col("line") / width).cast("bigint")
        return [F.struct(F.lit(scope).alias("scope"), b.alias("band")) for b in (band, band - 1)]

    groups = F.array(
        F.struct(F.lit(0).alias("scope"), F.col("line").cast("bigint").alias("band")),
        *bands(F.lit(window), 1),
        *bands(F.col("item_tokens"), 2),
    )
    first = F.max(F.struct("support", (-F.abs("line")).alias("near"), "line", "slots")).alias("w")
    occurrences = (
        matched.withColumn("group", F.explode(groups))
        .groupBy(*OF, "item_tokens", "group", "at", "width")
        .agg(first)
        .groupBy(*OF, "item_tokens", "group")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "width"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("w.slots"))).alias("slots"),
        )
    )

    def distinct_by(*names: str) -> Column:
        return F.size(
            F.array_distinct(F.transform("slots", lambda s: F.struct(*[s[n].alias(n) for n in names])))
        )

    one_to_one = (distinct_by("kind", "a") == F.size("slots")) & (
        distinct_by("kind", "b") == F.size("slots")
    )
    changed = (
        occurrences.filter(one_to_one)
        .groupBy(*OF)
        .agg(F.max(covered(F.col("spans"))).alias("covered"))
        .withColumnsRenamed({c: f"c_{c}" for c in OF})
    )
    same_pair = F.lit(True)
    for c in OF:
        same_pair = same_pair & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    both = alone.join(changed, same_pair, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    exact = F.col("same_covered") >= F.least(F.lit(run), F.ceil(F.col("item_tokens") / 2))
    other = F.col("covered") >= F.least(F.lit(run), F.col("item_tokens"))
    return both.filter(exact | other).select(
        *OF,
        "item_tokens",
        F.greatest("same_covered", F.when(other, F.col("covered"))).alias("covered"),
        F.when(exact & ((F.col("same_covered") >= F.col("covered")) | ~other), "exact")
        .otherwise("reparameterised")
        .alias("kind"),
    )


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 8,
    run: int = 13,
) -> DataFrame:
    """(id, item, item_tokens, covered, kind) for each document that holds an item; kind is
    exact or reparameterised."""
    best = F.max(F.struct("covered", "kind", "item_tokens")).alias("best")
    found = _leaks(docs, items, id, text, item, item_text, window, run)
    return found.groupBy("doc_id", "item_id").agg(best).select(
        F.col("doc_id").alias(id),
        F.col("item_id").alias(item),
        "best.item_tokens",
        "best.covered",
        "best.kind",
    )


def clean(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 8,
    run: int = 13,
) -> DataFrame:
    """The rows of `docs` whose text leaks no item."""
    found = _leaks(docs, items, id, text, item, item_text, window, run)
    at, key = unused(docs, "__id", "__key")
    found = written(
        found.select(F.col("doc_id").alias(at), F.col("doc_key").alias(key)).distinct(), "bench-leaks"
    )
    same = F.col(id).eqNullSafe(F.col(at)) & (F.xxhash64(F.col(text)) == F.col(key))
    return docs.join(_small(found), same, "left_anti")
