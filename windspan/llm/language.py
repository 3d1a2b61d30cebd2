"""Language identification by known words, backing off to character n-grams.

Learning counts words and their character n-grams per language on a bounded sample of labelled
rows: of each language the `per_language` distinct texts whose hashes are lowest. A known word scores its
smoothed log frequency in each language. An unseen word is covered from the left by known n-grams,
each time the longest that fits: from `longest` characters down to one; a character never seen
scores alike in all languages.

A text's scores are the means over its words; `score` is the softmax of these means times
`sharpness` words, so that long texts do not all score 1. Words are runs of letters in lower case,
of the whole text.

Defined results
    null text, no letters      `und`, score 0
    ties                       the language that is first in order of code points
    null language              not learned from
    no labelled rows           every text is `und`
    empty table                no rows
    other columns              not read
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from windspan.llm.sampling import lowest
from windspan.session import written

UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
KEPT_WORDS = 200_000  # words of the cache, which is emptied when full
FLOOR = 0.5  # added to each count


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


@dataclass
class LanguageModel:
    """Log frequencies: a row of `table` per known word or n-gram, a column per language.

    Rows of backed-off words follow the known ones while a task runs, `KEPT_WORDS` at most.
    """

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    longest: int
    sharpness: float

    def __post_init__(self):
        self.forget()

    def forget(self) -> None:
        self.rows = dict(self.words)
        self.used = len(self.table)
        room = np.zeros((KEPT_WORDS, len(self.languages)))
        self.scores = np.concatenate([self.table, room])

    def __getstate__(self):
        names = ("languages", "words", "grams", "table", "longest", "sharpness")
        return {k: getattr(self, k) for k in names}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _backed_off(self, word: str) -> np.ndarray:
        padded, at, parts = f" {word} ", 0, []
        while at < len(padded):
            for n in range(min(self.longest, len(padded) - at), 0, -1):
                known = self.grams.get(padded[at : at + n])
                if known is not None:
                    parts.append(known)
                    break
            else:
                n = 1
            at += n
        return self.table[parts].mean(axis=0) if parts else np.zeros(len(self.languages))

    def _row(self, word: str) -> int:
        row = self.rows.get(word)
        if row is None:
            if self.used == len(self.scores):
                self.forget()
            row = self.rows[word] = self.used
            self.scores[row] = self._backed_off(word)
            self.used += 1
        return row

    def _sums(self, words: list[str]) -> np.ndarray:
        """Summed scores of fewer than KEPT_WORDS words."""
        if self.used + len(words) > len(self.scores):
            self.forget()
        get = self.rows.get
        found = [get(w) for w in words]
        if None in found:
            found = [self._row(w) if i is None else i for i, w in zip(found, words)]
        return self.scores[found].sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text and self.languages else None
        if not words:
            return UNKNOWN, 0.0
        step = KEPT_WORDS // 2
        scores = sum(self._sums(words[i : i + step]) for i in range(0, len(words), step))
        scores = scores * (min(self.sharpness, len(words)) / len(words))
        chances = np.exp(scores - scores.max())
        best = int(scores.argmax())
        return self.languages[best], float(chances[best] / chances.sum())


def _frequencies(counts: DataFrame, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Rows and centred smoothed log frequencies of (lang, item, n)."""
    order = {lang: i for i, lang in enumerate(languages)}
    rows: dict[str, int] = {}
    found = [(rows.setdefault(r["item"], len(rows)), order[r["lang"]], r["n"]) for r in counts.collect()]
    table = np.full((len(rows), len(languages)), FLOOR)
    for row, column, n in found:
        table[row, column] += n
    logs = np.log(table / table.sum(axis=0)) if rows else table
    return rows, logs - logs.mean(axis=1, keepdims=True)


def learn(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    per_language: int = 1000,
    longest: int = 5,
    least: int = 2,
    sharpness: float = 8.0,
) -> LanguageModel:
    """Learn from at most `per_language` texts of each language; words and n-grams that these hold
    fewer than `least` times are left out."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"),
        F.xxhash64(F.col(text)).alias("h"),
        F.col(text).alias("text"),
    )
    picked = lowest(labelled.select("lang", "h").distinct(), "lang", "h", per_language)
    sample = (
        labelled.join(F.broadcast(picked), ["lang", "h"])  # per_language rows a language
        .groupBy("lang", "h")
        .agg(F.min("text").alias("text"))
        .select("lang", "text")
    )
    schema = "lang string, item string, gram boolean, n long"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: Counter = Counter()
            for language, body in zip(batch["lang"], batch["text"]):
                words.update((language, word) for word in words_of(body))
            found: Counter = Counter()
            for (language, word), n in words.items():
                found[language, word, False] += n
                padded = f" {word} "
                for size in range(1, longest + 1):
                    for at in range(len(padded) - size + 1):
                        found[language, padded[at : at + size], True] += n
            yield pd.DataFrame(
                [(*key, n) for key, n in found.items()], columns=["lang", "item", "gram", "n"]
            )

    counts = written(
        sample.mapInPandas(count, schema)
        .groupBy("lang", "item", "gram")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least),
        "language-counts",
    )
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    words, word_table = _frequencies(counts.filter("not gram"), languages)
    grams, gram_table = _frequencies(counts.filter("gram"), languages)
    grams = {item: row + len(words) for item, row in grams.items()}
    table = np.concatenate([word_table, gram_table])
    return LanguageModel(languages, words, grams, table, longest, sharpness)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """Struct column (lang_pred, score) for the texts of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            yield pd.DataFrame(
                [known.predict(t) for t in texts], columns=["lang_pred", "score"]
            )

    return identified(F.col(text))


def fold(id: Column) -> Column:
    """0 to 4, by the CRC-32 of the id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def identify(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", **options
) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of `docs`, learned from the rows that are not
    held out: four of five, by the id's CRC-32."""
    model = learn(docs.filter(fold(F.col(id)) != 0), text, lang, **options)
    return docs.select(
        F.col(id),
        (fold(F.col(id)) == 0).alias("held_out"),
        predict(docs, model, text).alias("found"),
    ).select(id, "held_out", "found.lang_pred", "found.score")


def identified_only(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", **options
) -> DataFrame:
    """The rows of `docs` whose language is known; `und` goes."""
    model = learn(docs.filter(fold(F.col(id)) != 0), text, lang, **options)
    named = docs.withColumn("__lang", predict(docs, model, text))
    return named.filter(F.col("__lang.lang_pred") != UNKNOWN).select(
        *[F.col(c) for c in docs.columns]
    )
