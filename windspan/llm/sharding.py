"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to `2 ** bits` levels, the levels give a row's cell, and cells are
visited along a Hilbert curve, so that a run of rows is close in all dimensions and a reader with
filters on some of them skips most shards. Runs are cut by row count: shard sizes are at most one
row apart.

No sort of all rows and no window over them: rows are counted per cell and slice of a cell, the
counts are summed along the curve, and a row's place is its slice's start plus its number within
the slice. There are at most `2 ** (bits * dimensions)` cells, each cut into `slices` by a hash of
the id, so that a cell with a third of all rows is spread over tasks.

Defined results
    null text             size 1 and CRC-32 0, as for empty text
    null metadata         the lowest level
    equal rows            follow each other in their slice; which comes first is not settled, and
                          makes no difference
    empty table           no rows
    clashing columns      the columns that `assign` adds replace those of the same name; helper
                          columns start with `__`
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from windspan.session import written

MOST_CELL_BITS = 16


def text_level(value: Column, bits: int) -> Column:
    """Level of a text: the same for equal values, even over levels."""
    prefix = F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 8), 16, 10)
    return F.pmod(prefix.cast("long"), F.lit(1 << bits)).cast("int")


def linear_level(value: Column, low: int | None, high: int | None, bits: int) -> Column:
    """Level of a whole number between `low` and `high`, in equal steps."""
    if low is None:
        return F.lit(0)
    step = (high - low) // (1 << bits) + 1
    offset = value.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    return F.coalesce(F.floor(offset / F.lit(step).cast("decimal(20,0)")).cast("int"), F.lit(0))


def bit_length(value: Column) -> Column:
    return F.length(F.bin(value))


def hilbert_index(cells: DataFrame, dims: list[str], bits: int, out: str) -> DataFrame:
    """`cells` with the place of each on the Hilbert curve (Skilling's transform, 2004)."""
    x = [f"__x{i}" for i in range(len(dims))]
    df = cells.withColumns({a: F.col(d).cast("int") for a, d in zip(x, dims)})
    c = F.col
    for q in range(bits - 1, 0, -1):
        low = (1 << q) - 1
        for a in x:
            on = c(a).bitwiseAND(F.lit(1 << q)) != 0
            flipped = c(x[0]).bitwiseXOR(F.lit(low))
            if a == x[0]:
                df = df.withColumn(a, F.when(on, flipped).otherwise(c(a)))
                continue
            swap = c(x[0]).bitwiseXOR(c(a)).bitwiseAND(F.lit(low))
            df = df.withColumn("__t", F.when(on, 0).otherwise(swap)).withColumns(
                {
                    x[0]: F.when(on, flipped).otherwise(c(x[0]).bitwiseXOR(c("__t"))),
                    a: c(a).bitwiseXOR(c("__t")),
                }
            )
    for a, b in zip(x, x[1:]):
        df = df.withColumn(b, c(b).bitwiseXOR(c(a)))
    turn = F.lit(0)
    for q in range(bits - 1, 0, -1):
        on = c(x[-1]).bitwiseAND(F.lit(1 << q)) != 0
        turn = turn.bitwiseXOR(F.when(on, F.lit((1 << q) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("__t", turn).withColumns({a: c(a).bitwiseXOR(c("__t")) for a in x})
    place = F.lit(0)
    for q in range(bits - 1, -1, -1):
        for a in x:
            bit = F.shiftright(c(a), q).bitwiseAND(F.lit(1))
            place = F.shiftleft(place, 1).bitwiseOR(bit)
    return df.withColumn(out, place).drop(*x, "__t")


def _cell(levels: list[Column], bits: int) -> Column:
    made = F.lit(0)
    for level in levels:
        made = F.shiftleft(made, bits).bitwiseOR(level)
    return made


def assign(
    docs: DataFrame,
    shards: int = 8,
    id: str = "doc_id",
    text: str = "text",
    labels: tuple[str, ...] = ("lang", "source"),
    bits: int = 3,
    slices: int = 1024,
) -> DataFrame:
    """`docs` with size, text_crc32, law, shard, slot and grown_shard.

    Dimensions are the `labels`, the bit length of the size, and the id.
    """
    n_dims = len(labels) + 2
    if bits * n_dims > MOST_CELL_BITS:
        raise ValueError(f"at most {MOST_CELL_BITS} bits for all dimensions together")
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    sized = docs.withColumns(
        {"__size": F.octet_length(body).cast("long") + 1, "__crc": F.crc32(body)}
    )
    least, most, small, large, total = sized.agg(
        F.min(id), F.max(id), F.min("__size"), F.max("__size"), F.count("*")
    ).first()
    small, large = (None, None) if small is None else (small.bit_length(), large.bit_length())
    levels = [text_level(F.col(c), bits) for c in labels] + [
        linear_level(bit_length(F.col("__size")), small, large, bits),
        linear_level(F.col(id), least, most, bits),
    ]
    id_hash = F.conv(
        F.substring(F.md5(F.coalesce(F.col(id).cast("string"), F.lit(""))), 1, 8), 16, 10
    )
    placed = sized.withColumns(
        {
            "__cell": _cell(levels, bits),
            "__slice": F.pmod(id_hash.cast("long"), F.lit(slices)).cast("int"),
        }
    )
    counts = written(placed.groupBy("__cell", "__slice").agg(F.count("*").alias("n")), "shard-counts")
    mask = F.lit((1 << bits) - 1)
    dims = {
        f"__d{i}": F.shiftright("__cell", bits * (n_dims - 1 - i)).bitwiseAND(mask)
        for i in range(n_dims)
    }
    cells = counts.groupBy("__cell").agg(F.sum("n").alias("n")).withColumns(dims)
    along = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # cells only
    cells = hilbert_index(cells, list(dims), bits, "place").select(
        F.col("__cell").alias("cell"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start")
    )
    inside = (
        Window.partitionBy("__cell")
        .orderBy("__slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(
        F.col("__cell").alias("cell"),
        F.col("__slice").alias("part"),
        F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("ahead"),
    )
    starts = written(
        starts.join(cells, "cell").select(
            F.col("cell").alias("__c"),
            F.col("part").alias("__p"),
            (F.col("start") + F.col("ahead")).alias("__start"),
        ),
        "shard-starts",
    )
    order = Window.partitionBy("__cell", "__slice").orderBy(id, "__size", "__crc")
    numbered = placed.join(
        starts, (F.col("__cell") == F.col("__c")) & (F.col("__slice") == F.col("__p"))
    ).withColumn("__at", F.col("__start") + F.row_number().over(order) - 1)
    shard = F.expr(f"(__at * {shards}) div {max(1, total)}")
    first = F.expr(f"(__shard * {total} + {shards - 1}) div {shards}")
    added = {
        "size": F.col("__size"),
        "text_crc32": F.col("__crc"),
        "law": F.lit("rows"),
        "shard": F.col("__shard").cast("int"),
        "slot": (F.col("__at") - first).cast("long"),
        "grown_shard": F.lit(None).cast("int"),
    }
    own = [F.col(c) for c in docs.columns if c not in added]
    return numbered.withColumn("__shard", shard).select(
        *own, *[v.alias(k) for k, v in added.items()]
    )
