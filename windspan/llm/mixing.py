"""Mix sources to target weights by thresholds on a hash of each document.

All sources share the words of the whole table by weight. A source's target is at most `most`
times its size; what is over goes to the others by weight. A document is taken once for each whole
time its source's target holds its source's size, and once more if its hash is below the source's
threshold; so the takes of a larger budget contain those of a smaller one.

The threshold comes from histograms, not from a sort: words are summed per source and bucket of
the hash's leading bits, the bucket in which the budget ends is found, and only this bucket is
refined by the next bits, until it holds one document (or documents of one hash). The last one is
taken if that comes nearer to the target.

Sources are a table throughout; only the water level needs them in order, one row per source.

Defined results
    null text           size 0
    null source         a source of its own, after all others
    null id, same id    hashed with the text; rows equal in both are taken or left together
    source of size 0    target 0; its documents are left
    empty table         no rows
    clashing columns    `apply` replaces columns of the names it adds; helper columns start
                        with `__`
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window, functions as F

from windspan.session import written

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(id: Column, text: Column, seed: str = "") -> Column:
    """60 hash bits of id and text."""
    parts = F.concat_ws(
        ":", F.lit(seed), F.coalesce(id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))
    )
    return F.conv(F.substring(F.md5(parts), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) of (source, source_size), by weights in order of source."""
    wide = "decimal(38,0)"
    unit = lcm(*weights)
    weight = F.element_at(
        F.array(*map(F.lit, weights)),
        F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, len(weights))
        + 1,
    )
    # Sources whose limit is smallest for their weight reach it first.
    per_weight = F.col("source_size").cast(wide) * F.expr(f"{unit} div weight")
    level = Window.orderBy("per_weight", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    df = (
        sizes.withColumn("weight", weight)
        .withColumn("per_weight", per_weight)
        .withColumn("limit", F.col("source_size") * most)
        .withColumns(
            {
                "total": F.sum("source_size").over(everything),
                "all_weight": F.sum("weight").over(everything),
                "limits_before": F.coalesce(F.sum("limit").over(before), F.lit(0)),
                "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            }
        )
    )
    full = F.col("limit").cast(wide) * (F.col("all_weight") - F.col("weight_before")) <= F.col(
        "weight"
    ) * (F.col("total") - F.col("limits_before")).cast(wide)
    df = df.withColumn("full", full).withColumns(
        {
            "left": F.col("total") - F.coalesce(F.sum(F.expr("if(full, limit, 0)")).over(everything), F.lit(0)),
            "open": F.sum(F.expr("if(full, 0, weight)")).over(everything),
        }
    )
    share = (F.col("weight") * F.col("left")).cast("double") / F.col("open").cast("double")
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share)
    return df.select("source", "source_size", target.alias("target"))


def thresholds(
    rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3
) -> DataFrame:
    """(source, source_size, target, whole, shift, below) of rows (source, size, hash): take a row
    `whole` times, and once more if its hash without its last `shift` bits is less than `below`."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, most).withColumn(
        "whole",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0)
        .cast("int"),
    )
    state = written(
        goal.withColumns(
            {
                "rest": F.greatest(
                    F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)
                ),
                "prefix": F.lit(0).cast("long"),
                "ahead": F.lit(0).cast("long"),
                "held": F.col("source_size"),
            }
        ),
        "mix-goals",
    )
    shift = HASH_BITS
    while shift > 0:
        was, shift = shift, shift - LEVEL_BITS
        inside = rows.alias("r").join(
            state.alias("s"),
            F.col("r.source").eqNullSafe(F.col("s.source"))
            & (F.shiftright(F.col("r.hash"), was) == F.col("s.prefix")),
        )
        bucket = F.shiftright(F.col("r.hash"), shift)
        kept = ["source_size", "target", "whole", "rest", "ahead"]
        histogram = inside.groupBy(
            F.col("s.source").alias("source"), bucket.alias("prefix")
        ).agg(
            F.sum("r.size").alias("held"),
            F.count("*").alias("n"),
            *[F.first(f"s.{c}").alias(c) for c in kept],
        )
        # at most 2 ** LEVEL_BITS buckets of a source
        along = Window.partitionBy("source").orderBy("prefix")
        summed = histogram.withColumns(
            {
                "below": F.col("ahead")
                + F.coalesce(
                    F.sum("held").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
                "last": F.lead("prefix").over(along).isNull(),
            }
        )
        ends = (F.col("below") <= F.col("rest")) & (
            (F.col("below") + F.col("held") > F.col("rest")) | F.col("last")
        )
        # Empty documents at the budget's end: the first bucket that goes beyond, or the last one.
        found = (
            summed.filter(ends)
            .withColumn("pick", F.row_number().over(along))
            .filter("pick = 1")
            .drop("pick", "last", "ahead")
            .withColumnRenamed("below", "ahead")
        )
        state = written(found, "mix-level")
        if (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    nearer = F.col("rest") - F.col("ahead") > F.col("held") / 2
    return state.select(
        "source",
        "source_size",
        "target",
        "whole",
        F.lit(shift).alias("shift"),
        F.when(F.col("rest") > 0, F.col("prefix") + nearer.cast("long"))
        .otherwise(0)
        .alias("below"),
    )


def measured(docs: DataFrame, id: str, text: str, source: str, seed: str = "") -> DataFrame:
    return docs.select(
        F.col(id).alias("id"),
        F.col(source).alias("source"),
        words(F.col(text)).alias("size"),
        document_hash(F.col(id), F.col(text), seed).alias("hash"),
    )


def mix_table(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
) -> DataFrame:
    """(id, size, source_size, target, taken, copies) for each row of `docs`."""
    rows = written(measured(docs, id, text, source), "mix-rows")
    found = thresholds(rows, weights, most)
    return (
        rows.alias("r")
        .join(found.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .withColumn("copies", F.expr("t.whole + cast(shiftright(r.hash, t.shift) < t.below as int)"))
        .select(
            F.col("r.id").alias(id),
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("copies")).alias("taken"),
            "copies",
        )
    )


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
) -> DataFrame:
    """The mixed table: each row of `docs` as often as the mix takes it."""
    found = thresholds(written(measured(docs, id, text, source), "mix-rows"), weights, most)
    found = found.select(
        F.col("source").alias("__source"),
        F.col("whole").alias("__whole"),
        F.col("shift").alias("__shift"),
        F.col("below").alias("__below"),
    )
    joined = docs.withColumn("__hash", document_hash(F.col(id), F.col(text))).join(
        found, F.col(source).eqNullSafe(F.col("__source"))
    )
    copies = F.expr("__whole + cast(shiftright(__hash, __shift) < __below as int)")
    times = F.when(copies > 0, F.array_repeat(F.lit(1), copies)).otherwise(F.array())
    return joined.withColumn("__take", F.explode(times)).select(*[F.col(c) for c in docs.columns])
