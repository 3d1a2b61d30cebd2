"""Row order inside a site without sorting a whole site in one task.

A site may hold a third of all rows, so no window here runs over a site's rows. Rows are dealt out by
ranges of (key, time), whose bounds Spark samples from the rows themselves, so a burst of rows in one
second is cut as finely as years of hours. In each range rows are counted off in order, and one row for
each key and range carries the number of rows before it. What needs neighbours then works on blocks
of SLOT_ROWS positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windspan.functions.clock import epoch_seconds
from windspan.operators.joins import attach_per_key
from windspan.session import written

SLOT_ROWS = 4096


def with_positions(
    df: DataFrame, keys: Sequence[str], time="time", slot_seconds: int | None = None
) -> DataFrame:
    """Add `pos` (0-based row position in the key by time), `n` (rows of the key) and `slot`, a
    number that grows with `pos` and is shared by at most SLOT_ROWS rows of the key.

    `time` must be unique in a key; a duplicate fails the job. Rows without a time get no position.
    Where rows are known to be spread evenly, `slot_seconds` cuts slots of that length by the clock
    instead, which needs no sorting by range.
    """
    keys = list(keys)
    if slot_seconds is not None:
        return _by_clock(df, keys, time, slot_seconds)
    by = ", ".join(f"`{k}`" for k in keys)
    ends = [F.col(f"`{c}`") for c in (*keys, time)]
    doubled = f"raise_error('duplicate row order key: {', '.join([*keys, time])}')"
    # The window asks for the rows of one (key, time) together and in order; ranges give both.
    counted = (
        df.repartitionByRange(*ends)
        .selectExpr("*", f"row_number() over (partition by {by}, `{time}` order by `{time}`) as _seen")
        .withColumn("_at", F.monotonically_increasing_id())
        .filter(f"if(_seen = 1, true, cast({doubled} as boolean))")
        .withColumns(
            {"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}
        )
        .drop("_seen")
    )
    # Stored, as another sampling would give other ranges.
    ranged = written(counted, "ranges")
    offsets = ranged.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(f"`{time}`").alias("_timed"),
        F.min(F.expr(f"if(`{time}` is null, null, _at)")).alias("_first"),
    )
    offsets = offsets.selectExpr(
        *[f"`{k}`" for k in keys],
        "_range",
        "_first",
        f"""coalesce(sum(_timed) over (partition by {by} order by _range
            rows between unbounded preceding and 1 preceding), 0) as _before""",
        f"sum(_rows) over (partition by {by}) as n",
    )
    placed = attach_per_key(ranged, offsets, [*keys, "_range"], spread_by=["_at"])
    return placed.selectExpr(
        *[f"`{c}`" for c in df.columns],
        f"if(`{time}` is null, null, _before + _at - _first) as pos",
        "n",
    ).selectExpr(*[f"`{c}`" for c in df.columns], f"pos div {SLOT_ROWS} as slot", "pos", "n")


def _by_clock(df: DataFrame, keys: list[str], time: str, slot_seconds: int) -> DataFrame:
    """Positions by slots of a fixed length: rows are ordered within a slot, and one row for each
    slot carries the number of rows before it. `df` is read twice, once for its keys and times."""
    by = ", ".join(f"`{k}`" for k in keys)
    slotted = df.withColumn("slot", F.floor(epoch_seconds(time) / slot_seconds))
    offsets = (
        slotted.groupBy(*keys, "slot")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .selectExpr(
            *[f"`{k}`" for k in keys],
            "slot",
            f"""coalesce(sum(_rows) over (partition by {by} order by slot
                rows between unbounded preceding and 1 preceding), 0) as _before""",
            f"sum(_rows) over (partition by {by}) as n",
        )
    )
    within = f"over (partition by {by}, slot order by `{time}`)"
    doubled = f"raise_error('duplicate row order key: {', '.join([*keys, time])}')"
    return (
        slotted.selectExpr(
            "*",
            f"row_number() {within} - 1 as _local",
            f"`{time}` <=> lag(`{time}`) {within} as _same",
        )
        .join(offsets, [*keys, "slot"], "left")
        .selectExpr(
            *[f"`{c}`" for c in df.columns],
            "slot",
            f"if(_same and _local > 0, cast({doubled} as bigint), _before + _local) as pos",
            "n",
        )
    )


def contiguous_folds(
    df: DataFrame, keys: Sequence[str], folds: int = 3, time="time", name="fold", **kw
) -> DataFrame:
    """Unshuffled k-fold number in row order; the first n % k folds hold one row more."""
    placed = with_positions(df, keys, time, **kw)
    size, longer = f"(n div {folds})", f"(n % {folds})"
    head = f"({longer} * ({size} + 1))"
    fold = f"""if(pos < {head}, pos div ({size} + 1),
        {longer} + (pos - {head}) div greatest({size}, 1))"""
    return placed.selectExpr(
        *[f"`{c}`" for c in df.columns if c != name], f"cast({fold} as int) as `{name}`"
    )


def moving_average(
    df: DataFrame,
    value: str,
    window: int = 5,
    keys: Sequence[str] = ("site",),
    time="time",
    block: int = 4096,
    **kw,
) -> DataFrame:
    """Centred moving average by row position, in place.

    Ends are padded with zeros and the sum is always divided by `window`; a key with fewer
    rows than `window` keeps its values. Rows near the edge of a block of positions are also
    sent to the neighbour block, where they serve the frame and are then dropped.
    """
    keys = list(keys)
    block = max(block, window)
    back, ahead = window // 2, window - 1 - window // 2
    by = ", ".join(f"`{k}`" for k in keys)
    homes = f"""array_compact(array(_home,
        if(pos % {block} < {ahead} and _home > 0, _home - 1, null),
        if(pos % {block} >= {block - back}, _home + 1, null)))"""
    spread = (
        with_positions(df, keys, time, **kw)
        .selectExpr("*", f"pos div {block} as _home")
        .selectExpr("*", f"explode({homes}) as _block")
    )
    frame = f"""over (partition by {by}, _block order by pos
        rows between {back} preceding and {ahead} following)"""
    v = f"`{value}`"
    smooth = f"""case when n < {window} then {v}
        when count({v}) {frame} = count(*) {frame} then sum({v}) {frame} / {window} end"""
    return (
        spread.selectExpr("*", f"{smooth} as _smooth")
        .filter("_block = _home")
        .selectExpr(*["_smooth as " + v if c == value else f"`{c}`" for c in df.columns])
    )
