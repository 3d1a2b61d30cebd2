"""Similarity digests of improbable features.

A text's byte windows are ranked by entropy: the more varied a window, the rarer it is taken to
be. A window that no other within `REACH` bytes on either side exceeds is a feature. Features go,
in text order, into a chain of Bloom filters, each of `PER_FILTER` features; the chain is the
fingerprint. Two chains are alike by the bits that they share, in excess of those that chance
makes them share and as part of the most they could share: for each filter of the shorter chain
the best of the other's, averaged by the bits set.

Neighbours by id are found without a global sort: ids are cut into slices of equal width, each
slice is streamed in order of id, and the first row of the next filled slice is appended to it.

Defined results
    null or empty text       no features: the empty fingerprint; alike (1) to itself, to others 0
    shorter than a window    the whole text is the one feature
    equal texts              equal fingerprints, likeness 1
    repeated ids             ordered by the hash of the text, then the text
    null ids                 before all others
    one row                  its own neighbour
    empty table              no rows
    other columns            not read
    very long texts          held one at a time
Rows that share one id, or ids crowded into one slice, are streamed by one task, in bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

WINDOW = 32
REACH = 16  # a power of two
FILTER_BITS = 2048
HASHES = 5
PER_FILTER = 128
CHUNK_BYTES = 1 << 16  # texts digested together: what fits a core's cache
MOST_SLICES = 1 << 16
ROWS_PER_SLICE = 1000
COMPARED = 1 << 14  # filter pairs compared at a time

_c = np.arange(WINDOW + 2, dtype=np.float64)
_SUM = np.rint(_c * np.log2(np.maximum(_c, 1)) * (1 << 20)).astype(np.int64)
#: What one more occurrence, the c-th, adds to the sum of c log c of a window's byte counts.
STEP = np.concatenate([[0], np.diff(_SUM)])
LOWEST = np.iinfo(np.int64).min


def window_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of each window of `data` by its start: whole numbers that rise with entropy."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    # Occurrences of each byte value side by side: neighbours within WINDOW count one another.
    order = np.argsort(data, kind="stable")
    small = n < 1 << 24
    kind, place = (np.uint32, 24) if small else (np.int64, 40)
    key = (data[order].astype(kind) << kind(place)) | order.astype(kind)
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for lag in range(1, WINDOW + 1):
        near = (key[lag:] - key[:-lag]) <= WINDOW
        if not near.any():
            break
        before[lag:] += near
        after[:-lag] += near
    counts = np.empty(n, np.uint8)
    counts[order] = before
    total = np.cumsum(STEP[counts])
    counts[order] = after
    total[WINDOW:] -= np.cumsum(STEP[counts])[:-WINDOW]
    return -total[WINDOW - 1 :]


def _next_max(values: np.ndarray) -> np.ndarray:
    """The largest of the REACH values from each place on."""
    width, out = 1, values
    while width < REACH:
        shifted = np.full(len(out), LOWEST)
        shifted[:-width] = out[width:]
        out = np.maximum(out, shifted)
        width *= 2
    return out


def features(texts: list[bytes]) -> list[list[int]]:
    """Hashes of each text's features in text order, without repeats."""
    joined = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    rank = window_ranks(np.frombuffer(joined, np.uint8))
    starts = ends - [len(t) for t in texts]
    if len(rank):
        # No window reaches from one text into the next.
        crossing = np.zeros(len(joined) + 1, np.int32)
        np.add.at(crossing, np.maximum(starts, ends - WINDOW + 1), 1)
        np.add.at(crossing, ends, -1)
        rank = np.where(np.cumsum(crossing)[: len(rank)] > 0, LOWEST, rank)
        best = _next_max(rank)
        left, right = np.full(len(rank), LOWEST), np.full(len(rank), LOWEST)
        left[REACH:] = best[:-REACH]
        for i in range(min(REACH, len(rank))):  # fewer than REACH values to the left
            left[i] = rank[:i].max() if i else LOWEST
        right[:-1] = best[1:]
        picked = np.flatnonzero((rank > left) & (rank >= right) & (rank > LOWEST))
    else:
        picked = np.empty(0, np.int64)
    edges = np.searchsorted(picked, np.append(starts, len(joined)))
    digest = xxhash.xxh64_intdigest
    made = []
    for text, a, b in zip(texts, edges, edges[1:]):
        if len(text) < WINDOW:
            made.append([digest(text)] if text else [])
        else:
            spans = picked[a:b].tolist()
            made.append(list(dict.fromkeys(digest(joined[i : i + WINDOW]) for i in spans)))
    return made


def filters(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's chain of Bloom filters, a row of bytes each."""
    found = features(texts)
    sizes = [-(-len(f) // PER_FILTER) for f in found]
    bits = np.zeros((sum(sizes), FILTER_BITS), bool)
    firsts = np.cumsum([0, *sizes])
    counts = np.array([len(f) for f in found])
    if counts.sum():
        hashes = np.fromiter((h for f in found for h in f), np.uint64, int(counts.sum()))
        number = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        row = np.repeat(firsts[:-1], counts) + number // PER_FILTER
        for k in range(HASHES):
            bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(int)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in zip(firsts, firsts[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 for two chains of filters."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    set_a = np.bitwise_count(a).sum(axis=1, dtype=np.int64)
    set_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    score, step = 0.0, max(1, COMPARED // len(b))
    wide_a, wide_b = a.view(np.uint64), b.view(np.uint64)
    for i in range(0, len(a), step):
        na, nb = set_a[i : i + step, None], set_b[None, :]
        shared = np.bitwise_count(wide_a[i : i + step, None] & wide_b[None]).sum(axis=2, dtype=np.int64)
        chance = na * nb / FILTER_BITS
        room = np.minimum(na, nb) - chance
        over = np.where(room > 0, (shared - chance) / np.where(room > 0, room, 1), 0)
        score += float((np.clip(over, 0, 1).max(axis=1) * na[:, 0]).sum())
    return score / float(set_a.sum())


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def edited(text: str, other: str) -> str:
    """`text` whose last half (its smaller one) is replaced by as much of the start of `other`."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


SCHEMA = (
    "id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def neighbours(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(slice, extra, id, hash, text) of all rows and, as `extra`, of each slice's successor."""
    rows = docs.select(
        F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    low, high, n = docs.agg(F.min(id), F.max(id), F.count("*")).first()
    slices = max(1, min(MOST_SLICES, n // ROWS_PER_SLICE))
    if low is None:
        place = F.lit(0)
    else:
        step = (high - low) // slices + 1
        offset = F.col("id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
        place = F.floor(offset / F.lit(step).cast("decimal(20,0)")).cast("int") + 1
    rows = rows.withColumn("slice", F.coalesce(place, F.lit(0)))
    firsts = rows.groupBy("slice").agg(F.min(F.struct("id", "hash")).alias("first"))
    along = Window.orderBy("slice")  # at most MOST_SLICES + 1 rows
    around = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn(
        "to", F.coalesce(F.lag("slice").over(along), F.last("slice").over(around))
    ).select("to", F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash"))
    extra = (
        rows.join(
            F.broadcast(firsts),
            F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")),
        )
        .groupBy("to", "id", "hash")
        .agg(F.min("text").alias("text"))
    )
    return rows.select("slice", F.lit(False).alias("extra"), "id", "hash", "text").unionByName(
        extra.select(F.col("to").alias("slice"), F.lit(True).alias("extra"), "id", "hash", "text")
    )


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its fingerprint, that of its edited text, and how alike its fingerprint is to
    that one and to the next row's by id (the first one's after the last)."""
    streamed = neighbours(docs, id, text)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = (
        streamed.repartition(partitions, "slice")
        .sortWithinPartitions("slice", "extra", "id", "hash", "text")
        .select("slice", "extra", "id", "text")
    )
    kind = docs.schema[id].dataType
    schema = SCHEMA.format(id=kind.simpleString())

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for its successor: slice, id, text, filters
        waiting: list[tuple] = []
        size, names, id_type = 0, None, None

        def flush() -> pa.RecordBatch:
            nonlocal held
            own = [t.encode() for _, _, _, t in waiting]
            pairs, last = [], held and (held[0], held[1], held[2], held[3])
            chains = filters(own)
            rows = []
            for (slice_, extra, key, body), chain in zip(waiting, chains):
                if last is not None and last[0] == slice_:
                    pairs.append((last[2], body))
                    rows.append((last, chain))
                last = None if extra else (slice_, key, body, chain)
            held = last
            texts = [edited(a, b).encode() for a, b in pairs]
            out = {k: [] for k in names}
            for (before, next_chain), change, changed in zip(rows, texts, filters(texts)):
                _, key, body, chain = before
                for column, value in zip(
                    out.values(),
                    (
                        key,
                        len(body),
                        hashlib.sha256(change).hexdigest(),
                        as_text(chain),
                        as_text(changed),
                        likeness(chain, changed),
                        likeness(chain, next_chain),
                    ),
                ):
                    column.append(value)
            waiting.clear()
            kinds = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), kinds)], names
            )

        for batch in batches:
            id_type = batch.schema.field("id").type
            names = [c.split()[0] for c in schema.split(", ")]
            for row in zip(*(batch.column(c).to_pylist() for c in ("slice", "extra", "id", "text"))):
                waiting.append(row)
                size += len(row[3])
                if size >= CHUNK_BYTES:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return streamed.mapInArrow(digested, schema).withColumnRenamed("id", id)
