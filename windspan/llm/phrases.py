"""Removal of passages that recur, by Aho-Corasick automata of recurring phrases.

A window of `window` words recurs if the same words start at another place in any document. Each
word under a recurring window is removed.

1. Equal texts become one, with their number. The distinct texts are a table bucketed by text
   key, so that what is found out about a text is joined to it without moving texts again.
2. Confirm. Each window has an anchor: the shingle of `shingle` words in it that hashes lowest.
   Equal windows have equal anchors, and neighbouring windows mostly share one: a text has about
   one anchor in 16 words. An anchor that occurs once has no recurring window. Where all places of
   an anchor agree in all words under its windows, all of them recur. Only for the other
   anchors are single windows counted.
3. Automata. Documents go through tasks in blocks of bounded size. A block's recurring windows give
   its phrases: of each run of windows enough to cover it. They are compiled into the block's
   automaton, whose size the block's text bounds, and the block's documents are streamed
   through it; the phrases that it finds are what is removed.

Counts are aggregated before each shuffle, so neither a very common passage nor a large group of
copies meets in one task.

Defined results
    null, empty or blank text    no words; the hash of the empty text
    fewer words than a window    nothing is removed
    equal texts                  from `window` words on nothing is left of any
    repeated rows and ids        are copies like others; one row each
    null ids                     keep their row
    empty table                  no rows
    other columns                not read
    bytes that are not UTF-8     are compared as bytes
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from windspan.session import new_table_dir, written

BLOCK_BYTES = 1 << 20  # of text, to one automaton
_rng = np.random.default_rng(35)
_MULTIPLIERS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 61)) * 8 + 3
_INVERSE = pow(_BASE, -1, 1 << 64)
WINDOW_SCHEMA = "key binary, copies long, anchor long, hash long, place int"
ANCHOR_SCHEMA = "key binary, copies long, anchor long, stretch long, span long"
RESULT_SCHEMA = "key binary, n_words long, n_removed long, kept_sha256 string"


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1, modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    filled, factor = 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(factor)
        filled += take
        factor = pow(base, filled, 1 << 64)
    return out[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Hashes of the words of a text, and of any run of them."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.words * _powers(_BASE, self.n), out=self.sums[1:])
        self.back = _powers(_INVERSE, self.n + 1)

    def runs(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words first .. end - 1."""
        return _mix((self.sums[end] - self.sums[first]) * self.back[first])

    def shingles(self, size: int) -> np.ndarray:
        count = self.n - size + 1
        total = np.zeros(count, np.uint64)
        for j in range(size):
            total += self.words[j : j + count] * _MULTIPLIERS[j]
        return _mix(total)


def anchors(hashed: Hashed, window: int, shingle: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, anchor's word) for each run of windows with one
    anchor; ties go to the leftmost."""
    pieces = hashed.shingles(shingle)
    width = window - shingle + 1
    starts = hashed.n - window + 1
    lowest = np.empty(starts, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(pieces, width)
    for at in range(0, starts, 1 << 14):
        part = views[at : at + (1 << 14)]
        lowest[at : at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    first = np.flatnonzero(np.append(True, lowest[1:] != lowest[:-1]))
    last = np.append(first[1:], starts) - 1
    return pieces[lowest[first]], first, last, lowest[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keys(key: bytes, n: int) -> pa.Array:
    return pa.array([key] * n, pa.binary())


def _distinct_texts(docs: DataFrame, text: str) -> str:
    """Write the distinct texts (key, copies, text) as a table bucketed by key; its name."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    texts = (
        docs.select(body.alias("text"))
        .groupBy(F.unhex(F.md5("text")).alias("key"))
        .agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    )
    name = f"distinct_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        texts.write.format("parquet")
        .option("compression", "zstd")
        .option("path", new_table_dir(spark, "distinct-texts"))
        .bucketBy(buckets, "key")
        .saveAsTable(name)
    )
    return name


def _anchored(window: int, shingle: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ANCHOR_SCHEMA.split(", ")]
        for batch in batches:
            for key, copies, body in zip(*(batch.column(c) for c in ("key", "copies", "text"))):
                words = body.as_py().split()
                if len(words) < window:
                    continue
                hashed = Hashed(words)
                anchor, first, last, place = anchors(hashed, window, shingle)
                stretch = hashed.runs(first, last + window)
                stretch = _mix(stretch + (place - first).astype(np.uint64))
                n = len(anchor)
                yield pa.RecordBatch.from_arrays(
                    [
                        _keys(key.as_py(), n),
                        pa.array(np.full(n, copies.as_py())),
                        _signed(anchor),
                        _signed(stretch),
                        pa.array((first << 32) | last),
                    ],
                    names,
                )

    return found


def _windows(window: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in WINDOW_SCHEMA.split(", ")]
        for batch in batches:
            columns = (batch.column(c) for c in ("key", "copies", "text", "places"))
            for key, copies, body, places in zip(*columns):
                hashed = Hashed(body.as_py().split())
                parts = places.values
                span = parts.field("span").to_numpy(zero_copy_only=False)
                anchor = parts.field("anchor").to_numpy(zero_copy_only=False)
                first, last = span >> 32, span & 0xFFFFFFFF
                counts = last - first + 1
                at = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(
                    np.cumsum(counts) - counts, counts
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        _keys(key.as_py(), len(at)),
                        pa.array(np.full(len(at), copies.as_py())),
                        pa.array(np.repeat(anchor, counts)),
                        _signed(hashed.runs(at, at + window)),
                        pa.array(at.astype(np.int32)),
                    ],
                    names,
                )

    return found


def window_runs(spans: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, last) of neighbouring recurring windows, of packed spans in any order."""
    runs: list[tuple[int, int]] = []
    for span in np.sort(spans).tolist():
        a, b = span >> 32, span & 0xFFFFFFFF
        if runs and a <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def removed_words(block: list[tuple[list[str], list[tuple[int, int]]]], window: int) -> list[np.ndarray]:
    """For each document (words, runs) of a block, which words its phrases cover."""
    automaton = ahocorasick.Automaton()
    for words, runs in block:
        for first, last in runs:
            for at in [*range(first, last, window), last]:
                automaton.add_word(f" {' '.join(words[at : at + window])} ", True)
    found = []
    if len(automaton):
        automaton.make_automaton()
    for words, _ in block:
        change = np.zeros(len(words) + 1, np.int64)
        if len(automaton) and len(words) >= window:
            # The blank after each word, in the text with a blank before and after each word.
            blanks = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            ends = np.fromiter(
                (end for end, _ in automaton.iter(f" {' '.join(words)} ")), np.int64
            )
            last = np.searchsorted(blanks, ends)
            np.add.at(change, last - window + 1, 1)
            np.add.at(change, last + 1, -1)
        found.append(np.cumsum(change)[:-1] > 0)
    return found


def _stripped(window: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[bytes, list[str], list[tuple[int, int]]]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows: tuple[list, ...] = ([], [], [], [])
            block = [(words, runs) for _, words, runs in waiting]
            for (key, words, _), gone in zip(waiting, removed_words(block, window)):
                kept = " ".join(w for w, g in zip(words, gone.tolist()) if not g)
                digest = hashlib.sha256(kept.encode("latin-1")).hexdigest()
                for column, value in zip(rows, (key, len(words), int(gone.sum()), digest)):
                    column.append(value)
            waiting.clear()
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows, kinds)],
                [c.split()[0] for c in RESULT_SCHEMA.split(", ")],
            )

        for batch in batches:
            for key, body, spans in zip(*(batch.column(c) for c in ("key", "text", "spans"))):
                data = body.as_py()
                # Bytes as characters, so that any bytes can be told apart.
                words = [w.decode("latin-1") for w in data.split()]
                packed = spans.values.to_numpy() if spans.is_valid else np.empty(0, np.int64)
                waiting.append((key.as_py(), words, window_runs(packed)))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return found


def recurring_spans(texts: DataFrame, window: int, shingle: int) -> DataFrame:
    """(key, spans): packed runs of recurring windows (first << 32 | last) of each text."""
    placed = written(texts.mapInArrow(_anchored(window, shingle), ANCHOR_SCHEMA), "anchors")
    # Written before the join, so that Spark can split a hot key's side of it.
    anchors_kept = written(
        placed.groupBy("anchor")
        .agg(
            F.sum("copies").alias("places"),
            (F.min("stretch") == F.max("stretch")).alias("alike"),
        )
        .filter("places > 1")
        .select("anchor", "alike"),
        "anchor-kinds",
    )
    shared = written(
        placed.select("key", "copies", "anchor", "span").join(anchors_kept, "anchor"),
        "shared-anchors",
    )
    unlike = (
        shared.filter("not alike")
        .groupBy("key")
        .agg(F.collect_list(F.struct("span", "anchor")).alias("places"))
    )
    windows = written(
        texts.join(unlike, "key").mapInArrow(_windows(window), WINDOW_SCHEMA), "windows"
    )
    again = written(
        windows.groupBy("anchor", "hash")
        .agg(F.sum("copies").alias("n"))
        .filter("n > 1")
        .select("anchor", "hash"),
        "recurring-windows",
    )
    single = F.expr("shiftleft(cast(place as bigint), 32) + place").alias("span")
    spans = (
        windows.join(again, ["anchor", "hash"])
        .select("key", single)
        .unionByName(shared.filter("alike").select("key", "span"))
    )
    # at most one span per word of a text
    return spans.groupBy("key").agg(F.collect_list("span").alias("spans"))


def strip_recurring(
    spark: SparkSession,
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    window: int = 35,
    shingle: int = 5,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row of `docs`."""
    texts = spark.table(_distinct_texts(docs, text))
    spans = recurring_spans(texts, window, shingle)
    stripped = texts.join(spans, "key", "left").mapInArrow(_stripped(window), RESULT_SCHEMA)
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return (
        docs.select(F.col(id).alias("id"), F.unhex(F.md5(body)).alias("key"))
        .join(stripped, "key")
        .select(F.col("id").alias(id), "n_words", "n_removed", "kept_sha256")
    )
