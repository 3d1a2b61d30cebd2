"""Audit of how filters interact, from the removals of every coalition of them.

Each document fails some of n filters. For each part of the table (a language) and each of the 2**n
coalitions, the documents that fail any filter of the coalition are counted: its removals. All else
follows from that table. What a filter removes in an order of filters is the difference of two
coalitions, and its Shapley value is the solution of a constrained least-squares fit: of all additive
scores that share out the removals of the full coalition, the one nearest to all others' removals,
weighted by the Shapley kernel. The normal equations are solved in rationals, so the value is exact.

Only rows of identifiers and flags are shuffled, never texts. Copies are found by digest: of the rows
with one text those with the smallest id pass, and (digest, id) is joined with itself on both columns,
so a group of copies of any size is spread over all tasks.

Defined results
    null text                 an empty text
    null part                 the part ''
    null id                   never a copy of another row, no other's smaller id, without labels
    repeated rows             one document each; rows of one id are no copies of one another
    several labels of one id  good (toxic) if any row says so
    ties                      none: counts do not depend on the order of rows
    very long texts           read whole, one at a time
    empty tables              no rows (documents); nothing good or toxic (labels)
    other columns             not read; names of helper columns cannot clash with them
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

from windspan.session import written

#: Conditions of failure, over `text` and its `words`, by the letter that stands for the filter.
FILTERS = {
    "A": "size(words) < 100",
    "B": "100L * size(array_distinct(words)) < 80L * size(words)",
    "C": "100L * (length(text) - length(regexp_replace(text, '[A-Z]+', ''))) > 10L * length(text)",
    "D": "text rlike '[#$%&*|]'",
}
COPIES = "E"
WORD = r"[^\x20\x09-\x0D]+"
MOST_FILTERS = 7  # 5,040 orders and 128 coalitions for each part


def solved(rows: list[list[Fraction]]) -> list[Fraction]:
    """The solution of a regular linear system of rows [coefficients..., right side]."""
    rows = [list(r) for r in rows]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(len(rows)):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [r[-1] for r in rows]


def shapley_values(removals: list[int]) -> list[Fraction]:
    """The Shapley value of each filter, from the removals of coalitions in order of their bits.

    Minimises the sum over proper coalitions S of kernel(S) * (removals(S) - sum of S's values) ** 2
    under the condition that all values add up to the removals of all filters.
    """
    n = (len(removals) - 1).bit_length()
    normal = [[Fraction(0)] * n for _ in range(n)]
    right = [Fraction(0)] * n
    for s in range(1, (1 << n) - 1):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        members = [i for i in range(n) if s >> i & 1]
        for i in members:
            right[i] += weight * (removals[s] - removals[0])
            for j in members:
                normal[i][j] += weight
    one = Fraction(1)
    system = [[*normal[i], one, right[i]] for i in range(n)]  # the last unknown is the multiplier
    system.append([one] * n + [Fraction(0), Fraction(removals[-1] - removals[0])])
    return solved(system)[:n]


def _summed_over_orders(removals):
    """n! times each Shapley value: what a filter removes, summed over all orders."""
    values = shapley_values(removals)
    return [int(v * factorial(len(values))) for v in values]


def failures(
    docs: DataFrame,
    filters: Mapping[str, str] = FILTERS,
    copies: str | None = COPIES,
    id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """(id, part, mask, n): rows of `docs` by the filters that they fail, bit by bit in the order
    of `filters`; the last bit is `copies`, if any."""
    rows = docs.select(
        F.col(id).alias("id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    mask = F.lit(0)
    for bit, condition in enumerate(filters.values()):
        mask = mask + F.when(F.expr(condition), 1 << bit).otherwise(0)
    masked = rows.select("id", "part", F.sha2("text", 256).alias("digest"), mask.alias("mask"))
    if copies is None:
        return masked.groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    counted = written(
        masked.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "audit-rows"
    )
    least = counted.groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("least"))
    first = (F.col("digest") == F.col("d")) & (F.col("id") == F.col("least"))
    copy = F.col("id").isNotNull() & F.col("d").isNull()
    return (
        counted.join(least, first, "left")
        .withColumn("mask", F.col("mask") + F.when(copy, 1 << len(filters)).otherwise(0))
        .groupBy("id", "part", "mask")
        .agg(F.sum("n").alias("n"))
    )


def coalitions(failed: DataFrame, labels: DataFrame, n_filters: int, id: str = "doc_id") -> DataFrame:
    """(part, coalition, removed, good, toxic, total): for each part all 2 ** n_filters coalitions,
    with zeros."""

    def any_row(name: str) -> Column:
        return F.max(F.when(F.col(name) == 1, 1).otherwise(0))

    by_id = (
        labels.filter(F.col(id).isNotNull())
        .groupBy(F.col(id).alias("label_id"))
        .agg(any_row("quality").alias("good"), any_row("toxic").alias("toxic"))
    )
    masks = (
        failed.join(by_id, F.col("id") == F.col("label_id"), "left")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        )
    )
    every = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    goes = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    return (
        masks.withColumn("coalition", F.explode(every))
        .groupBy("part", "coalition")
        .agg(
            *[
                F.sum(F.when(goes, F.col(c)).otherwise(0)).alias(name)
                for c, name in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))
            ],
            F.sum("n").alias("total"),
        )
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, str] = FILTERS,
    copies: str | None = COPIES,
    id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """One row for each part, order of all filters and step in it, with document counts.

    kept: left after the step. removed: gone at it. redundant: fail its filter, gone earlier.
    unique_fails: fail its filter only. good_lost, toxic_lost: of the removed. shapley: the filter's
    removals summed over all orders. Filters are SQL conditions over `text` and `words`, each under
    one letter; `copies` is the letter of the condition that a smaller id has the same text.
    """
    letters = [*filters, *([copies] if copies else [])]
    n = len(letters)
    if not 0 < n <= MOST_FILTERS or any(len(x) != 1 for x in letters) or len(set(letters)) < n:
        raise ValueError(f"up to {MOST_FILTERS} filters, each under its own letter: {letters}")
    table = coalitions(failures(docs, filters, copies, id, text, part), labels, n, id)
    solve = F.udf(_summed_over_orders, "array<bigint>")
    cells = F.array_sort(F.collect_list(F.struct("coalition", "removed", "good", "toxic")))
    parts = (
        table.groupBy("part")  # 2 ** n rows each
        .agg(cells.alias("cells"), F.max("total").alias("total"))
        .withColumn("shares", solve(F.transform("cells", lambda c: c["removed"])))
    )

    orders = F.array(*[F.lit("".join(o)) for o in permutations(sorted(letters))])
    bit = F.create_map(*[F.lit(x) for i, letter in enumerate(letters) for x in (letter, i)])
    steps = (
        parts.withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("filter", F.expr("substring(filter_order, step, 1)"))
        .withColumn("bit", bit[F.col("filter")])
        .withColumn("own", F.expr("shiftleft(1, bit)"))
        .withColumn(
            "before",
            F.aggregate(
                F.filter(F.split("filter_order", ""), lambda x, i: i < F.col("step") - 1),
                F.lit(0),
                lambda acc, x: acc + F.call_function("shiftleft", F.lit(1), bit[x]),
            ),
        )
    )

    def of(coalition: Column, name: str = "removed") -> Column:
        return F.get(F.col("cells"), coalition)[name]

    before, own, full = F.col("before"), F.col("own"), F.lit((1 << n) - 1)
    removed = of(before + own) - of(before)
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - of(before + own)).alias("kept"),
        removed.alias("removed"),
        (of(own) - removed).alias("redundant"),
        (of(full) - of(full - own)).alias("unique_fails"),
        (of(before + own, "good") - of(before, "good")).alias("good_lost"),
        (of(before + own, "toxic") - of(before, "toxic")).alias("toxic_lost"),
        F.get("shares", F.col("bit")).alias("shapley"),
    )
