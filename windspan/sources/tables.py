"""Stage tables: series, target, features, forecasts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windspan.functions.clock import target_parts, wall_clock
from windspan.functions.missing import normalise_missing
from windspan.functions.names import file_stem, matched_tag
from windspan.operators.joins import site_of_tag
from windspan.operators.selection import TARGET_EXTRAS
from windspan.operators.unions import concat_fill
from windspan.session import setting, written
from windspan.sites import Site, sites_frame
from windspan.sources.snapshots import snapshot_footers, unglobbed, uri_decoded

_MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What `read` reads, or None if there is no such path or no file in it."""
    try:
        return read()
    except AnalysisException as error:
        if (error.getCondition() or "").startswith(_MISSING):
            return None
        raise


NANOS = "timestamp[ns"


def _from_nanoseconds(name: str, zoned: bool) -> Column:
    whole = F.expr(f"`{name}` div 1000 - if(`{name}` % 1000 < 0, 1, 0)")
    at = F.timestamp_micros(whole)
    if zoned:
        return at
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame | None:
    """All rows of the Parquet files of a listing (`path`), with `_file`, the path each came from.

    Columns that some files lack are NULL. Files with nanosecond times are found by their footers
    and copied into a written table with microseconds; the setting that reading them takes holds
    for that copy only. None if there is no file.
    """
    footers = written(snapshot_footers(files.select("path")), "footers")
    broken = [r.path for r in footers.filter("not readable").select("path").take(5)]
    if broken:
        raise ValueError(f"not Parquet: {', '.join(broken)}")
    # A few kinds of files, each with its nanosecond columns.
    kinds = (
        footers.withColumn("nanos", F.filter("fields", lambda f: f["stored"].startswith(NANOS)))
        .groupBy("nanos")
        .agg(F.array_sort(F.collect_list("path")).alias("paths"))
        .orderBy("nanos")
        .collect()
    )
    made = []
    for kind in kinds:
        reader = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true")
        paths = [unglobbed(p) for p in kind.paths]

        def cells() -> DataFrame:
            return reader.parquet(*paths).select("*", uri_decoded("_metadata.file_path").alias("_file"))

        if not kind.nanos:
            made.append(cells())
            continue
        with setting(spark, "spark.sql.legacy.parquet.nanosAsLong", "true"):
            rows = cells()
            for field in kind.nanos:
                rows = rows.withColumn(field.name, _from_nanoseconds(field.name, "tz=" in field.stored))
            made.append(written(rows, "microseconds"))
    return concat_fill(made) if made else None


def write_by_site(df: DataFrame, path: str) -> None:
    (
        df.hint("rebalance", "site")
        .sortWithinPartitions("site", "time")
        .write.mode("overwrite")
        .partitionBy("site")
        .parquet(path)
    )


def write_series(series: DataFrame, parquet: str, csv: str | None = None) -> None:
    """Parquet by site and, if wanted, CSV; the CSV is made from the Parquet."""
    write_by_site(series, parquet)
    if csv is not None:
        stored = series.sparkSession.read.parquet(parquet).select(*series.columns)
        stored.orderBy("site", "time").write.mode("overwrite").option("header", True).csv(csv)


def read_series(spark: SparkSession, path: str, sites: Sequence[Site]) -> DataFrame:
    """The stored series; every configured site must be there."""
    series = if_present(lambda: spark.read.parquet(path))
    if series is None:
        raise FileNotFoundError(f"no series at {path}")
    series = series.withColumn("site", F.col("site").cast("string"))
    wanted = sites_frame(spark, sites).select("site")
    absent = wanted.join(series.select("site").distinct(), "site", "left_anti")
    names = [r.site for r in absent.collect()]  # no more than the site list
    if names:
        raise FileNotFoundError(f"no series at {path} for: {', '.join(sorted(names))}")
    return normalise_missing(series.filter(F.col("site").isin([s.site for s in sites])))


def read_series_files(
    spark: SparkSession, path: str, sites: Sequence[Site], suffix: str = "_timeseries_MAX"
) -> DataFrame:
    """Series kept as one file a site, `{label}_test/{label}_timeseries_MAX.parquet` below `path`.

    A file is a site's if its name is the site's label or name and the suffix. One look at the
    names, one scan of the files that are some site's; every configured site must be there.
    """
    files = if_present(lambda: list_files(spark, path, f"*{suffix}.parquet"))
    names = {name: s.site for s in sites for name in (s.label, s.site)}
    site = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    stem = F.regexp_extract("path", rf"/([^/]+){suffix}\.parquet(?:/[^/]*)?$", 1)
    found = None if files is None else written(
        files.select("path", site[stem].alias("site")).filter("site is not null"), "series-files"
    )
    have = set() if found is None else {r.site for r in found.select("site").distinct().collect()}
    missing = [f"{s.site} ({s.label}{suffix}.parquet)" for s in sites if s.site not in have]
    if missing:
        raise FileNotFoundError(f"no series at {path} for: {', '.join(missing)}")
    rows = read_files(spark, found)
    stem = F.regexp_extract("_file", rf"/([^/]+){suffix}\.parquet(?:/[^/]*)?$", 1)
    series = rows.drop("site").withColumns(
        {"site": site[stem], "time": F.col("time").cast("timestamp_ntz")}
    )
    return normalise_missing(series.drop("_file", "__index_level_0__"))


def write_series_files(series: DataFrame, path: str, sites: Sequence[Site]) -> None:
    """One Parquet a site under its label, as `read_series_files` reads them."""
    for s in sites:
        (
            series.filter(F.col("site") == s.site)
            .drop("site")
            .write.mode("overwrite")
            .parquet(f"{path}/{s.label}_test/{s.label}_timeseries_MAX.parquet")
        )


def list_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """The files below `path` whose name, or whose folder's name, is like `glob`."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length")
    )
    like = re.escape(glob).replace(r"\*", "[^/]*")
    return files.filter(F.col("path").rlike(rf"/{like}(?:/[^/]*)?$"))


def read_target(
    spark: SparkSession, path: str, pattern: str | None = None, sites: Sequence[Site] = ()
) -> DataFrame:
    """All target files, each row tagged by its file name; columns some files lack are NULL.

    Without a pattern, the tag is the part of the name that is a tag of `sites`, be it
    `wind_{tag}` or `{tag}_target`, else the last part."""
    files = if_present(lambda: list_files(spark, path))
    raw = None if files is None else read_files(spark, files)
    if raw is None:
        raise FileNotFoundError(f"no target files at {path}")
    known = [s.target_tag for s in sites]
    tag = matched_tag(file_stem("_file"), pattern, known)
    kept = [F.col(f"`{c}`") for c in raw.columns if c not in (*TARGET_EXTRAS, "filename", "_file")]
    return normalise_missing(raw.select(*kept, tag.alias("filename")))


def localise_target(
    target: DataFrame, sites: Sequence[Site], keep_unknown: bool = False
) -> DataFrame:
    """Add `site`, strip the zone of `end_datetime` in the site's zone, add date and hour.

    Rows with a tag no site has can join nothing: they are left out, or kept without a site and by
    the first site's clock."""
    if keep_unknown:
        names = F.create_map(*[F.lit(x) for s in sites for x in (s.target_tag, s.site)])
        known = target.withColumn("site", names[F.col("filename")])
    else:
        known = site_of_tag(target, sites, strict=False)
    if isinstance(target.schema["end_datetime"].dataType, T.TimestampType):
        zones = F.create_map(*[F.lit(x) for s in sites for x in (s.site, s.tz)])
        zone = F.coalesce(zones[F.col("site")], F.lit(sites[0].tz))
        known = known.withColumn("end_datetime", wall_clock("end_datetime", zone))
    return known.withColumns(target_parts("end_datetime"))


def write_target(target: DataFrame, path: str) -> None:
    target.write.mode("overwrite").parquet(path)


def read_features(
    spark: SparkSession, path: str, sites: Sequence[Site]
) -> tuple[DataFrame | None, list[str]]:
    """Finished features, one Parquet per site under its short name, in one scan.

    Returns (features, []) or (None, the names that are missing).
    """
    names = {s.short: s.site for s in sites}
    site = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    files = if_present(lambda: list_files(spark, path))
    stem = file_stem("path")
    found = None if files is None else written(
        files.filter(site[stem].isNotNull()).select("path", stem.alias("short")), "feature-files"
    )
    have = set() if found is None else {r.short for r in found.select("short").distinct().collect()}
    missing = [short for short in names if short not in have]
    if missing:
        return None, missing
    rows = read_files(spark, found).drop("__index_level_0__", "site")
    made = rows.withColumns(
        {"site": site[file_stem("_file")], "time": F.col("time").cast("timestamp_ntz")}
    )
    return normalise_missing(made.drop("_file")), []


def write_features(features: DataFrame, path: str, sites: Sequence[Site]) -> None:
    """One Parquet per site under its short name; read back by `read_features`."""
    for s in sites:
        (
            features.filter(F.col("site") == s.site)
            .drop("site")
            .write.mode("overwrite")
            .parquet(f"{path}/{s.short}.parquet")
        )


def write_forecast(forecast: DataFrame, path: str) -> None:
    forecast.write.mode("overwrite").option("header", True).csv(path)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(
        "time timestamp_ntz, energy_kwh double, plant_name string"
    ).csv(path)
