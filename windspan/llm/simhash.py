"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint holds 64 bits. Two documents are linked if their fingerprints differ in at most
`max_bits` bits. The fingerprint is cut into `max_bits // 2 + 1` segments, so that of two linked
fingerprints one segment differs in at most one bit: both then hold the same *variant* of that
segment, the one with this bit blanked. Variants are joined by equality and the pairs checked.

Equal fingerprints are one node, so a group of copies of any size costs one row. A variant that
more than `dense` fingerprints share is not paired off: its fingerprints are indexed with
`max_bits` blanked bits, where all that meet in a key are linked and a star to the smallest says
so. A key then holds at most 2 ** max_bits fingerprints.

Defined results
    null, empty or blank text   fingerprint 0, linked like any other
    fewer words than a shingle  the whole word sequence is the one shingle
    null `id`                   keeps its row; it is no smallest id unless all in reach are null
    repeated rows and ids       one row each; they share a component
    empty table                 no rows
    other columns               not read; names of helper columns cannot clash with them
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from windspan.llm.components import component_labels
from windspan.session import written

BITS = 64
SEED = 42  # the seed of Spark's own xxhash64
BROADCAST_ROWS = 200_000  # of 20 bytes; beyond it the variants are shuffled to the join
CHUNK = 1 << 16  # hashes whose bits are counted at a time


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The SimHash of UTF-8 `text` as a signed long."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[: 1 - shingle or None], ends[shingle - 1 :]
        spans = zip(first.tolist(), last.tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(last))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(text: Column, shingle: int = 3) -> Column:
    """Bigint fingerprint of a text column."""

    @F.pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return hashed(text.cast("binary"))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def one_blank_masks(max_bits: int) -> list[int]:
    """For each segment and each of its bits, the mask that keeps the segment without the bit."""
    cuts = max_bits // 2 + 1
    edges = [round(i * BITS / cuts) for i in range(cuts + 1)]
    return [
        _signed(sum(1 << i for i in range(a, b)) & ~(1 << bit))
        for a, b in zip(edges, edges[1:])
        for bit in range(a, b)
    ]


def _meeting_variant(differing: Column, max_bits: int) -> Column:
    """The one variant in which a pair counts, of those that it shares: of the first segment with
    at most one differing bit, that bit's or else the first."""
    cuts = max_bits // 2 + 1
    edges = [round(i * BITS / cuts) for i in range(cuts + 1)]
    found = F.lit(None).cast("int")
    for a, b in reversed(list(zip(edges, edges[1:]))):
        part = F.shiftrightunsigned(differing, a)
        if b < BITS:
            part = part.bitwiseAND(F.lit((1 << (b - a)) - 1))
        place = F.when(part < 0, b - a - 1).otherwise(F.bit_count(F.greatest(part, F.lit(1)) - 1))
        found = F.when(F.bit_count(part) <= 1, F.lit(a) + place).otherwise(found)
    return found


def all_blank_masks(max_bits: int) -> list[int]:
    """Masks that keep all but `max_bits` bits."""
    full = (1 << BITS) - 1
    return [_signed(full & ~sum(1 << b for b in bits)) for bits in combinations(range(BITS), max_bits)]


def _variants(nodes: DataFrame, masks: list[int]) -> DataFrame:
    masked = F.transform(
        F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseAND(m)
    )
    return nodes.select("fp", F.posexplode(masked).alias("variant", "kept"))


def links(nodes: DataFrame, max_bits: int = 2, dense: int = 256) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints `fp` that keep all components whole.

    Every linked pair is in the result but for pairs of a dense variant, which stars link.
    """
    if max_bits < 0 or max_bits > 3:
        raise ValueError("max_bits is 0 to 3")
    if max_bits == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    variants = _variants(nodes, one_blank_masks(max_bits))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    close = (F.bit_count(differing) <= max_bits) & (
        F.col("variant") == _meeting_variant(differing, max_bits)
    )
    shared = written(
        variants.groupBy("variant", "kept")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1"),
        "simhash-variants",
    )
    twos = shared.filter("n = 2").filter(close).select("a", "b")
    more = shared.filter("n > 2").select("variant", "kept", "n")
    if more.count() <= BROADCAST_ROWS:
        more = F.broadcast(more)
    members = written(variants.join(more, ["variant", "kept"]), "simhash-members")
    few = members.filter(F.col("n") <= dense)
    left = few.select("variant", "kept", F.col("fp").alias("a"))
    right = few.select(
        F.col("variant").alias("v"), F.col("kept").alias("k"), F.col("fp").alias("b")
    )
    met = (F.col("variant") == F.col("v")) & (F.col("kept") == F.col("k"))
    pairs = left.join(right, met & (F.col("a") < F.col("b")) & close).select("a", "b")
    crowd = members.filter(F.col("n") > dense).select("fp").distinct()
    stars = (
        _variants(crowd, all_blank_masks(max_bits))
        .groupBy("variant", "kept")
        .agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps"))  # at most 2 ** max_bits
        .filter(F.size("fps") > 1)
        .select("a", F.explode("fps").alias("b"))
        .filter("a < b")
    )
    return twos.unionByName(pairs).unionByName(stars).distinct()


def _classes(prints: DataFrame, max_bits: int, dense: int) -> DataFrame:
    """(class_fp, root, component_id) for each distinct fingerprint of `prints` (id, fp)."""
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    edges = links(nodes.select("fp"), max_bits, dense)
    # node, root: one row for each fingerprint with a link
    labels = component_labels(edges, "a", "b")
    grouped = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return grouped.join(smallest, "root").select(
        F.col("fp").alias("class_fp"), "root", "component_id"
    )


def _prints(docs: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    return written(
        docs.select(F.col(id).alias("id"), with_fingerprint(F.col(text), shingle).alias("fp")),
        "simhash-prints",
    )


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
    dense: int = 256,
) -> DataFrame:
    """(id, fingerprint, component_id) for each row of `docs`; component_id is the smallest `id`
    that links lead to."""
    prints = _prints(docs, id, text, shingle)
    classes = _classes(prints, max_bits, dense)
    return prints.join(classes, prints.fp == classes.class_fp).select(
        F.col("id").alias(id),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def representatives(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
    dense: int = 256,
) -> DataFrame:
    """`docs` with one row of each component: that of its smallest id, null after all others.

    Unlike texts under one id are documents of their own: each counts for the component it is in,
    and of those with the smallest id of one component that with the smallest hash stays. Of rows
    with the same id and text one stays, that whose other columns come first as JSON.
    """
    key = F.xxhash64(F.col(text))
    prints = written(
        docs.select(
            F.col(id).alias("id"), key.alias("key"), with_fingerprint(F.col(text), shingle).alias("fp")
        ),
        "simhash-prints",
    )
    classes = _classes(prints.select("id", "fp"), max_bits, dense).select("class_fp", "root")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("first")
    # Equal ids and texts have one fingerprint, so an id and text is of one component.
    distinct = prints.groupBy("fp", "id", "key").agg(F.count("*"))
    chosen = distinct.join(classes, F.col("fp") == F.col("class_fp")).groupBy("root").agg(first)
    chosen = written(
        chosen.select(F.struct("first.id", "first.key").alias("__chosen")), "simhash-chosen"
    )
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Texts are shuffled once, copies combined before: the join is by the key that groups the rows,
    # of the very type it is stored with. In a struct a null id equals a null id.
    at = F.struct(F.col(id).alias("id"), key.alias("key")).cast(chosen.schema["__chosen"].dataType)
    return (
        docs.groupBy(at.alias("__at"))
        .agg(F.min_by(row, F.to_json(F.struct(*rest))).alias("__row"))
        .join(chosen, F.col("__at") == F.col("__chosen"), "left_semi")
        .select("__row.*")
    )
