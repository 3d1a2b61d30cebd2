"""Divergence of the sources of a language from one another and from the language, by term.

Terms are counted by language and source, and those in enough documents of the language are kept.
Each group (language, source) and each language gives every kept term a whole-number share p of
about SCALE, one count added to each. The divergence of a group from a peer sums
floor((p - q)^2 / q) over all kept terms, q the peer's share; its most typical terms are those by
which it diverges most from its language.

Pairs of sources are summed row by row, as in Gustavson's sparse matrix product. Tasks hold terms
with the groups that have them, term-major. Each group runs through its terms and scatters, for each
peer in the term's entry, into a dense accumulator over all peers of its language; no pair of
postings becomes a row. Most terms are missing in a group or its peer, where the share is the zero
share z. The sum is first taken as if no term were in both: a group's terms against the peer's z, the
peer's terms against the group's z, z against z for all others. That needs no terms but how many have
each count, which is one row a group. The accumulators hold the correction for the terms in both,
f(p, q) - f(p, z') - f(z, q) + f(z, z').

An accumulator has one cell a peer, and a task holds those of so many groups as CELLS cells allow;
languages with more sources are dealt out in blocks of groups. The result itself has one row for each
two sources of a language, so their number is bounded by what can be returned.

All numbers are exact: shares are quotients of decimals, at most SCALE + 1, and as a group's shares add
up to about SCALE, a pair's sums stay below 2^63 for less than a thousand million kept terms.

Defined results
    null language, source  ''
    null or empty text     its group occurs, with or without terms
    null and repeated ids  not read; every row is a document
    ties                   by item, in order of UTF-8 bytes
    no kept term           pairs with value 0, no terms
    very long texts        cut between terms into pieces that are counted one by one
    empty table            no rows
    other columns          not read; names of helper columns cannot clash with them
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from windspan.operators.joins import attach_per_key
from windspan.session import written

SCALE = 1_000_000_000
CELLS = 1 << 22  # of 8 bytes, in a task's accumulators
ENTRIES = 200_000  # terms counted in a task before they are passed on
PIECE = 1 << 22  # bytes of a text that are split at a time

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z to lower case, other ASCII than letters to blanks; bytes of other letters stay.
TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(b" ", at, at + PIECE)
        if cut <= at:  # one term longer than a piece
            cut = text.find(b" ", at + PIECE)
            if cut < 0:
                break
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (lang, source, term) of the rows seen so far, passed on whenever they are many.
    A group's occurrence is a row with a null term."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}

    def passed_on() -> pa.RecordBatch:
        rows: list[tuple] = []
        for (lang, source), (n, docs) in counts.items():
            rows.append((lang, source, None, 0, 0))
            rows += [(lang, source, term, k, docs[term]) for term, k in n.items()]
        counts.clear()
        columns = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.string()),
                pa.array(columns[1], pa.string()),
                pa.array(columns[2], pa.binary()).cast(pa.string()),
                pa.array(columns[3], pa.int64()),
                pa.array(columns[4], pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )

    held = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2)):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _pieces(text.as_py().translate(TERMS)):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n) - before
            if held >= ENTRIES:
                yield passed_on()
                held = 0
    yield passed_on()


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and one
    row with a null term for each group."""
    rows = docs.select(
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    # Rows of a group side by side, so that a task meets a term of few groups many times; a large
    # group is cut by the rows' places.
    near = rows.repartitionByRange("lang", "source", F.monotonically_increasing_id())
    return (
        near.mapInArrow(_count_batches, COUNTS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); without a term, 1."""
    count, whole = (n + 1).cast("decimal(19,0)"), (total + terms).cast("decimal(20,0)")
    return F.coalesce(1 + F.call_function("div", count * F.lit(SCALE), F.nullif(whole, F.lit(0))), F.lit(1))


def _gain(p, q):
    """floor((p - q)^2 / q), of columns or arrays of long."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), q)
    return (p - q) * (p - q) // q


class _Accumulators:
    """The dense accumulators of one block of a language's groups."""

    def __init__(self, lang: str, block: int, peers: int):
        self.lang, self.peers = lang, peers
        self.rows = max(1, CELLS // peers)
        self.first = block * self.rows
        self.cells = np.zeros((min(self.rows, peers - self.first), peers), np.int64)

    def scatter(self, starts: np.ndarray, group: np.ndarray, p: np.ndarray, z: np.ndarray) -> None:
        """Terms whose entries begin at `starts`: each group of the block through its terms."""
        ends = np.append(starts[1:], len(group))
        term = np.repeat(np.arange(len(starts)), ends - starts)
        mine = np.flatnonzero((group >= self.first) & (group < self.first + len(self.cells)))
        mine = mine[np.argsort(group[mine], kind="stable")]
        cuts = np.flatnonzero(np.diff(group[mine])) + 1
        for places in np.split(mine, cuts) if len(mine) else ():
            low, size = starts[term[places]], (ends - starts)[term[places]]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            peer = np.repeat(low, size) + inner
            own, zero = np.repeat(p[places], size), z[places[0]]
            q, q0 = p[peer], z[peer]
            both = _gain(own, q) - _gain(own, q0) - _gain(zero, q) + _gain(zero, q0)
            np.add.at(self.cells[group[places[0]] - self.first], group[peer], both)

    def sums(self) -> Iterator[pa.RecordBatch]:
        for row, cells in enumerate(self.cells):
            peers = np.flatnonzero(cells)
            if len(peers):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([self.lang] * len(peers), pa.string()),
                        pa.array(np.full(len(peers), self.first + row), pa.int32()),
                        pa.array(peers, pa.int32()),
                        pa.array(cells[peers], pa.int64()),
                    ],
                    names=["lang", "a", "b", "value"],
                )


def _scatter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections (lang, a, b, value) from rows sorted by (lang, block, term)."""
    now: _Accumulators | None = None
    key: tuple = ()

    def whole_terms() -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if len(rows):
                keys = rows[["lang", "block", "term"]]
                last = np.flatnonzero((keys != keys.shift()).any(axis=1))[-1]
                held = rows.iloc[last:]  # this term may go on
                yield rows.iloc[:last]
        if held is not None:
            yield held

    for rows in whole_terms():
        if not len(rows):
            continue
        head = rows[["lang", "block"]]
        turns = np.flatnonzero((head != head.shift()).any(axis=1).to_numpy())
        for low, high in zip(turns, np.append(turns[1:], len(rows))):
            part = rows.iloc[low:high]
            found = (part["lang"].iloc[0], int(part["block"].iloc[0]))
            if found != key:
                if now is not None:
                    yield from now.sums()
                key, now = found, _Accumulators(*found, int(part["peers"].iloc[0]))
            term = part["term"].to_numpy()
            starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            now.scatter(starts, *(part[c].to_numpy(np.int64) for c in ("group", "p", "z")))
    if now is not None:
        yield from now.sums()


def _corrections(postings: DataFrame) -> DataFrame:
    """(lang, a, b, value): what terms in both groups `a` and `b` change."""
    blocks = F.ceil(F.col("peers") / F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("peers"))))
    term_major = (
        postings.select(
            "lang",
            F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"),
            "term",
            "group",
            "peers",
            "p",
            "z",
        )
        .repartition("lang", "block", "term")
        .sortWithinPartitions("lang", "block", "term")
    )
    return term_major.mapInArrow(_scatter_batches, "lang string, a int, b int, value bigint")


def _baseline(counts, terms, z, peers, kept):
    """Over all peers, as if no term were in both: this group's sum against each (`own`), but for
    the peer's terms, and what this group's terms add to each peer's sum (`other`)."""
    zs = np.array([x["z"] for x in peers], np.int64)
    sizes = np.array([x["terms"] for x in peers], np.int64)
    own = (kept - terms - sizes) * _gain(np.int64(z), zs)
    other = np.zeros(len(zs), np.int64)
    for x in counts or ():
        p = np.int64(x["p"])
        own += x["terms"] * _gain(p, zs)
        other += x["terms"] * _gain(zs, p)
    return own.tolist(), other.tolist()


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    shares = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    shares = shares.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(
        F.collect_list(F.struct("p", "terms")).alias("counts")
    )  # a group of N terms has at most sqrt(2 N) different counts
    peers = groups.groupBy(F.col("lang").alias("pl")).agg(
        F.array_sort(F.collect_list(F.struct("group", "source", "z", "terms"))).alias("peers_of")
    )
    baseline = F.udf(_baseline, "struct<own: array<bigint>, other: array<bigint>>")
    based = (
        groups.join(shares, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left")
        .join(peers, F.col("lang") == F.col("pl"))
        .withColumn("base", baseline("counts", "terms", "z", "peers_of", "kept"))
    )
    based = written(based.select("lang", "source", "group", "peers_of", "base"), "divergence-base")

    def each(name: str) -> DataFrame:
        return based.select(
            "lang",
            "source",
            F.col("group").alias("a"),
            F.posexplode(F.arrays_zip("peers_of", F.col(f"base.{name}").alias("value"))).alias("b", "x"),
        ).select("lang", "source", "a", "b", F.col("x.peers_of.source").alias("item"), "x.value")

    own = each("own").filter("a <> b")
    added = (
        each("other")
        .select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
        .unionByName(_corrections(postings))
        .filter("a <> b")
        .groupBy("lang", "a", "b")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("more"))
    )
    total = (F.col("value").cast("decimal(38,0)") + F.coalesce("more", F.lit(0))).cast("bigint")
    return own.join(added, ["lang", "a", "b"], "left").select(
        "lang", "source", "item", total.alias("value")
    )


def divergence(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least_docs: int = 3,
    top: int = 200,
) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows of a group and each other source of its
    language, `term` rows of its `top` terms above the language's share."""
    counts = written(term_counts(docs, lang, source, text), "divergence-counts")
    of_term = Window.partitionBy("lang", "term")  # one row a source
    kept = written(
        counts.filter("term is not null")
        .select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("n").over(of_term).alias("lang_n"),
            F.sum("docs").over(of_term).alias("lang_docs"),
            (F.min("source").over(of_term) == F.col("source")).alias("first"),
        )
        .filter(F.col("lang_docs") >= least_docs)
        .drop("lang_docs"),
        "divergence-terms",
    )
    sums = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("terms"),
        F.sum(F.col("first").cast("bigint")).alias("first"),
    )
    of_lang = Window.partitionBy("lang")  # one row a source
    groups = (
        counts.filter("term is null")
        .select("lang", "source")
        .join(sums, ["lang", "source"], "left")
        .fillna(0, ["total", "terms", "first"])
        .select(
            "lang",
            "source",
            "total",
            "terms",
            F.sum("first").over(of_lang).alias("kept"),
            F.sum("total").over(of_lang).alias("lang_total"),
            F.count("*").over(of_lang).cast("int").alias("peers"),
            (F.row_number().over(of_lang.orderBy("source")) - 1).alias("group"),
        )
        .withColumn("z", _share(F.lit(0), F.col("total"), F.col("kept")))
    )
    groups = written(groups, "divergence-groups")
    joined = attach_per_key(
        kept.drop("first"), groups.drop("terms"), ["lang", "source"], spread_by=["term"]
    )
    postings = written(
        joined.withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept"))).withColumn(
            "q", _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        ),
        "divergence-postings",
    )

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.select(
            "lang",
            "source",
            F.lit(part).alias("part"),
            "item",
            "value",
            F.row_number().over(order).alias("rank"),
        )

    terms = postings.filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), _gain(F.col("p"), F.col("q")).alias("value")
    )
    return ranked(_pairs(postings, groups), "pair").unionByName(
        ranked(terms, "term").filter(F.col("rank") <= top)
    )
