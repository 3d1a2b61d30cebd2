"""Joins. Equi-joins on (site, time) spread by time, so one big site does not fill one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windspan import sites as site_module
from windspan.operators.selection import near_any_site
from windspan.session import written
from windspan.sites import Site, sites_frame, small_side

SALT_BUCKETS = 64
MIN_TILE = 0.001
MAX_TILES = 20_000


def site_of_tag(df: DataFrame, sites: Sequence[Site], tag="filename", strict=True) -> DataFrame:
    """Add `site` for a target tag; an unknown tag fails the job, or is dropped if not strict."""
    names = sites_frame(df.sparkSession, sites).select("site", F.col("target_tag").alias("_tag"))
    if not strict:
        return df.join(small_side(names, len(sites)), F.col(tag) == F.col("_tag")).drop("_tag")
    joined = df.join(small_side(names, len(sites)), F.col(tag) == F.col("_tag"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown site tag: "), F.coalesce(tag, F.lit("NULL"))))
    return joined.withColumn("site", F.coalesce("site", unknown.cast("string"))).drop("_tag")


def with_site_columns(
    df: DataFrame, sites: Sequence[Site], columns: Sequence[str], strict=True
) -> DataFrame:
    """Look up site attributes by `site`; an unknown site fails the job if strict."""
    attrs = sites_frame(df.sparkSession, sites).select(F.col("site").alias("_site"), *columns)
    joined = df.join(small_side(attrs, len(sites)), F.col("site") == F.col("_site"), "left")
    if strict:
        unknown = F.raise_error(
            F.concat(F.lit("unknown site: "), F.coalesce("site", F.lit("NULL")))
        )
        joined = joined.filter(
            F.when(F.col("_site").isNotNull(), True).otherwise(unknown.cast("boolean"))
        )
    else:
        joined = joined.filter(F.col("_site").isNotNull())
    return joined.drop("_site")


def _tile_step(sites: Sequence[Site]) -> float:
    """Tile edge in degrees: as small as the smallest box, so that few boxes share a tile, but
    doubled until the list of tiles stays short."""
    widths = [2 * float(w) for s in sites for w in (s.lat_range, s.lon_range) if w > 0]
    step = max(min(widths, default=1.0), MIN_TILE)
    while step < 360 and _tile_count(sites, step) > max(MAX_TILES, 4 * len(sites)):
        step *= 2
    return step


def _tile_count(sites: Sequence[Site], step: float) -> int:
    total = 0
    for s in sites:
        south, north, west, east = s.box
        rows = math.floor(north / step) - math.floor(south / step) + 1
        cols = math.floor(east / step) - math.floor(west / step) + 1
        total += rows * cols
    return total


def cells_of_sites(
    grid: DataFrame, sites: Sequence[Site], lat="latitude", lon="longitude"
) -> DataFrame:
    """Every grid cell once per site whose box holds it.

    The range join becomes an equi-join: both sides are cut into square tiles, a box is listed
    under each tile it touches, and the exact box test runs on the few pairs that share a
    tile. A cell falls in one tile and a site is listed there once, so no pair is doubled.
    """
    step = _tile_step(sites)
    tile = f"floor({{}} / {step!r}D)"

    def tiles(low: str, high: str) -> str:
        return f"explode(sequence({tile.format(low)}, {tile.format(high)}))"

    boxes = (
        sites_frame(grid.sparkSession, sites)
        .selectExpr(
            "site as _site",
            "lat_min",
            "lat_max",
            "lon_min",
            "lon_max",
            f"{tiles('lat_min', 'lat_max')} as _tile_lat",
        )
        .selectExpr("*", f"{tiles('lon_min', 'lon_max')} as _tile_lon")
    )
    cells = grid.filter(near_any_site(sites, lat, lon)).selectExpr(
        "*", f"{tile.format(lat)} as _tile_lat", f"{tile.format(lon)} as _tile_lon"
    )
    return (
        cells.join(small_side(boxes, _tile_count(sites, step)), ["_tile_lat", "_tile_lon"])
        .filter(f"{lat} between lat_min and lat_max and {lon} between lon_min and lon_max")
        .selectExpr("_site as site", *[f"`{c}`" for c in grid.columns])
    )


def join_target(series: DataFrame, target: DataFrame, time="time", at="end_datetime") -> DataFrame:
    """Left join of measured output. Two rows without a time match each other."""
    right = target.withColumnsRenamed({"site": "_site", at: "_at"})
    clash = set(series.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    on = (series["site"] == right["_site"]) & series[time].eqNullSafe(right["_at"])
    return series.join(right, on, "left").drop("_site", "_at")


def pending_dates(dates: DataFrame, done: DataFrame, keys=("site", "date")) -> DataFrame:
    """Dates not processed yet, in order."""
    return dates.join(done, list(keys), "left_anti").orderBy(*reversed(list(keys)))


def attach_per_key(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str] = ("time",),
    max_rows: int | None = None,
) -> DataFrame:
    """Add the columns of a one-row-per-key table to every row of `df`.

    Where the caller knows no bound on the table, it is stored and its rows are counted from
    the file footers. A table within the bound is broadcast. Beyond it, rows of a key are
    spread over salt buckets by their `spread_by` columns and the table is repeated once per
    bucket, so a key with a third of all rows is shared by many tasks. Missing keys match each
    other.
    """
    keys = list(keys)
    if max_rows is None:
        per_key = written(per_key, "per-key")
        max_rows = per_key.count()
    if max_rows <= site_module.BROADCAST_ROWS:
        return _null_safe(df, F.broadcast(per_key), keys)
    salt = f"pmod(xxhash64({', '.join(spread_by)}), {SALT_BUCKETS}L)"
    salted = df.selectExpr("*", f"{salt} as _salt")
    repeated = per_key.selectExpr("*", f"explode(sequence(0L, {SALT_BUCKETS - 1}L)) as _salt")
    return _null_safe(salted, repeated, [*keys, "_salt"]).drop("_salt")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, on, "left").drop(*[f"_r_{k}" for k in keys])
