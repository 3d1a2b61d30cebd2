"""A full hourly spine, and linear interpolation along it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windspan.functions.clock import epoch_seconds
from windspan.operators.rows import with_positions
from windspan.sites import Site

SLOT_ROWS = 4096


def spine(bounds: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Every step from `lo` to `hi` of each site, as (site, time, pos).

    Days are listed first and spread, then the steps of each day, so a long range is not one
    array in one task.
    """
    reach = F.floor(F.timestamp_diff("SECOND", "lo", "hi") / step_seconds)
    run = max(1, 86400 // step_seconds)
    first = F.explode(F.sequence(F.lit(0).cast("long"), reach, F.lit(run).cast("long")))
    runs = (
        bounds.filter(F.col("lo") <= F.col("hi"))
        .select("site", "lo", reach.alias("_reach"), first.alias("_first"))
        .repartition("site", "_first")
    )
    last = F.least(F.col("_first") + run - 1, F.col("_reach"))
    return runs.select(
        "site", "lo", F.explode(F.sequence(F.col("_first"), last)).alias("pos")
    ).select(
        "site",
        F.timestamp_add("SECOND", F.col("pos") * step_seconds, F.col("lo")).alias("time"),
        "pos",
    )


def spine_bounds(spark, sites: Sequence[Site]) -> DataFrame:
    rows = [(s.site, s.spine_start, s.spine_end) for s in sites if s.gaps == "interpolate"]
    return spark.createDataFrame(rows, "site string, lo string, hi string").select(
        "site", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi")
    )


def on_spine(df: DataFrame, bounds: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Exactly the spine's rows; rows of `df` off the spine go, a duplicate (site, time) fails."""
    seen = F.row_number().over(Window.partitionBy("site", "time").orderBy("time"))
    doubled = F.raise_error(
        F.concat(F.lit("duplicate row for site "), F.col("site"), F.lit(" at "), F.col("time").cast("string"))
    )
    checked = (
        df.filter(F.col("time").isNotNull())
        .withColumn("_seen", seen)
        .filter(F.when(F.col("_seen") == 1, True).otherwise(doubled.cast("boolean")))
        .drop("_seen")
    )
    rest = [c for c in df.columns if c not in ("site", "time")]
    return (
        spine(bounds, step_seconds)
        .join(checked, ["site", "time"], "left")
        .select("site", "time", *rest, "pos")
    )


def interpolate(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("site",),
    time="time",
    pos: str | None = None,
    slot_rows: int = SLOT_ROWS,
    **kw,
) -> DataFrame:
    """Fill gaps on a straight line by row position.

    A leading gap stays; a trailing gap repeats the last value. `pos` names a column that
    already holds row positions (a spine's). Known neighbours are looked up within a slot of
    rows; where the slot has none, they come from a table with the first and last known value
    of each slot, carried along the slots of a key.
    """
    keys, columns = list(keys), list(columns)
    if pos is None:
        placed = with_positions(df, keys, time, **kw).drop("n")
        at = "pos"
    else:
        placed = df.withColumn("slot", F.floor(F.col(pos) / slot_rows))
        at = pos

    by = ", ".join(f"`{k}`" for k in keys)
    numbers = range(len(columns))
    # SQL text: with dozens of columns, building these as Column objects takes longer than
    # running them on a small series.
    aggs = []
    for i, c in enumerate(columns):
        known_at = f"if(`{c}` is null, null, {at})"
        # Plain numbers per slot, so the partial aggregate stays a hash aggregate.
        aggs += [
            F.expr(f"max({known_at}) as _lp{i}"),
            F.expr(f"max_by(cast(`{c}` as double), {known_at}) as _lv{i}"),
            F.expr(f"min({known_at}) as _fp{i}"),
            F.expr(f"min_by(cast(`{c}` as double), {known_at}) as _fv{i}"),
        ]
    edges = placed.groupBy(*keys, "slot").agg(*aggs)

    def carry(p: str, v: str, order: str) -> str:
        pair = f"if({p} is null, null, named_struct('p', {p}, 'v', {v}))"
        return (
            f"last({pair}, true) over (partition by {by} order by {order}"
            " rows between unbounded preceding and 1 preceding)"
        )

    carried = edges.selectExpr(
        *keys,
        "slot",
        *[f"{carry(f'_lp{i}', f'_lv{i}', 'slot')} as _in{i}" for i in numbers],
        *[f"{carry(f'_fp{i}', f'_fv{i}', 'slot desc')} as _out{i}" for i in numbers],
    )

    def nearest(c: str, order: str) -> str:
        pair = f"if(`{c}` is null, null, named_struct('p', {at}, 'v', cast(`{c}` as double)))"
        return (
            f"last({pair}, true) over (partition by {by}, slot order by {order}"
            " rows between unbounded preceding and current row)"
        )

    # A look ahead is a look back in reverse order; a frame that ends at the last row would be
    # summed anew for every row.
    around = (
        placed.join(carried, [*keys, "slot"], "left")
        .selectExpr("*", *[f"{nearest(c, at)} as _b{i}" for i, c in enumerate(columns)])
        .selectExpr("*", *[f"{nearest(c, f'{at} desc')} as _a{i}" for i, c in enumerate(columns)])
        .selectExpr(
            "*",
            *[f"coalesce(_b{i}, _in{i}) as _before{i}" for i in numbers],
            *[f"coalesce(_a{i}, _out{i}) as _after{i}" for i in numbers],
        )
    )

    def filled(i: int, c: str) -> str:
        b, a = f"_before{i}", f"_after{i}"
        return (
            f"case when `{c}` is not null then cast(`{c}` as double)"
            f" when {a} is null then {b}.v"
            f" else {b}.v + ({a}.v - {b}.v) * (({at} - {b}.p) / ({a}.p - {b}.p)) end as `{c}`"
        )

    made = {c: filled(i, c) for i, c in enumerate(columns)}
    return around.selectExpr(*[made.get(c, f"`{c}`") for c in df.columns])
