"""One query per operator over the given tables.

A frame that is used more than once is written to the shared folder first, so the grid is
scanned once, not once per use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windspan.functions import physics
from windspan.functions.clock import (
    calendar_parts,
    compact_date,
    date_between,
    parse_time,
    target_parts,
    wall_clock,
)
from windspan.functions.names import file_stem, folder_date_text, stem_date_text, stem_tag, stem_time
from windspan.functions.output import regime, uplift_clip
from windspan.operators import aggregates as agg
from windspan.operators import joins
from windspan.operators.dual import fit_dual
from windspan.operators.gaps import interpolate, on_spine
from windspan.operators.many import fit_many
from windspan.operators.models import assemble, fit_linear, tree_estimator, tree_params
from windspan.operators.rows import contiguous_folds, moving_average
from windspan.operators.search import (
    SearchSettings,
    Whole,
    regime_rows,
    search,
    usable_regimes,
)
from windspan.operators.selection import (
    NOT_FEATURES,
    TARGET_EXTRAS,
    drop_incomplete,
    exclude_times,
    feature_columns,
    in_box,
    near_any_site,
    numeric_projection,
    split_rows,
)
from windspan.operators.unions import concat_fill, concat_strict
from windspan.plans import table_views as v
from windspan.plans.forecast import (
    SMOOTHING,
    SiteForecast,
    features_of,
    regular_features,
    rows_where,
)
from windspan.plans.table_views import SITES, doubles, rounded
from windspan.session import new_table_dir, written
from windspan.sites import site_named
from windspan.sources import mirror, snapshots, tables
from windspan.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
HIGH_DAY_SHARE = 0.5
DAY_FACTOR = 1.05


def site_features(spark: SparkSession, d: str) -> DataFrame:
    """The minimum slice: range join, hourly maximum, target join, wind features, order."""
    joined = joins.join_target(v.series(spark, d), _site_target(spark, d))
    full = physics.derived_features(joins.with_site_columns(joined, SITES, ["turbine_rad"]))
    out = full.select(
        "site",
        "time",
        "energy_kwh",
        "wind_speed",
        "wind_speed_squared",
        "wind_direction",
        "wind_energy",
    )
    return rounded(out, "wind_speed", "wind_speed_squared", "wind_direction", "wind_energy").orderBy(
        "site", "time"
    )


def _site_target(spark, d):
    return joins.site_of_tag(v.target(spark, d), SITES).select("site", "end_datetime", "energy_kwh")


# Selection.
def bbox_filter(spark, d):
    return v.grid(spark, d).filter(in_box(site_named(SITES, "gyeongju").box))


def date_range(spark, d):
    day = F.date_format("time", "yyyyMMdd")
    return v.grid(spark, d).filter(date_between(day, "2024-01-05", "2024-01-20")).select(
        "time", "latitude", "longitude", "pmsl"
    )


def site_filter(spark, d):
    return v.target(spark, d).filter(F.col("filename") == "yeongduk")


def numeric_cast(spark, d):
    """Numeric columns only: text and time columns go, doubles become float."""
    return doubles(numeric_projection(v.table(spark, d, "events")))


def literal_cols(spark, d):
    return v.grid(spark, d).select(
        "time",
        "pmsl",
        F.lit("경주풍력").alias("plant_name"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("run_time"),
    )


def drop_cols(spark, d):
    extra = v.target(spark, d).withColumns(
        {"energy_mwh": F.col("energy_kwh") / 1000, "period_hours": F.lit(1)}
    )
    return extra.drop(*TARGET_EXTRAS)


def feature_cols(spark, d):
    days = v.daily(spark, d).withColumns(calendar_parts("time"))
    return days.select(*feature_columns(days))


def exclude_time(spark, d):
    hours = v.series(spark, d).select("site", "time", "pmsl")
    return doubles(exclude_times(hours, {s.site: s.excluded_time for s in SITES}))


def _with_holes(df):
    return df.withColumns(
        {
            "ta_1p5m": F.when(F.hour("time") % 7 != 0, F.col("ta_1p5m")),
            "pmsl": F.when(F.hour("time") % 11 == 0, F.lit(float("nan")).cast("float")).otherwise(
                F.col("pmsl")
            ),
        }
    )


def drop_missing(spark, d):
    hours = v.series(spark, d).select("site", "time", "ta_1p5m", "pmsl")
    return doubles(drop_incomplete(_with_holes(hours)))


def _days(spark, d):
    """Daily rows, stored: the queries below use them more than once."""
    return written(v.daily(spark, d), "days")


def year_split(spark, d):
    days = _days(spark, d).withColumns(calendar_parts("time"))
    train, test = split_rows(days, "year <= 1998", "year = 1999")
    return concat_strict(
        [p.withColumn("part", F.lit(n)) for p, n in ((train, "train"), (test, "test"))]
    )


def month_parity_split(spark, d):
    days = _days(spark, d).withColumns(calendar_parts("time"))
    train, test = split_rows(days, "month % 2 = 1", "month % 2 = 0")
    return concat_strict(
        [p.withColumn("part", F.lit(n)) for p, n in ((train, "train"), (test, "test"))]
    )


def _regimes(spark, d):
    days = _days(spark, d)
    caps = agg.capacity_by_factor(days, DAY_FACTOR)
    return joins.attach_per_key(days, caps, ["site"]).withColumn(
        "regime", regime("energy_kwh", "capacity", HIGH_DAY_SHARE)
    )


def regime_split(spark, d):
    return _regimes(spark, d).select("site", "time", "energy_kwh", "regime")


def regime_counts(spark, d):
    return agg.regime_counts(_regimes(spark, d))


# Joins.
def site_grid_join(spark, d):
    return joins.cells_of_sites(v.grid(spark, d), SITES)


def site_lookup(spark, d):
    known = joins.site_of_tag(v.target(spark, d), SITES)
    return joins.with_site_columns(known, SITES, ["plant_name", "turbine_rad"])


def target_join(spark, d):
    return doubles(joins.join_target(v.series(spark, d), _site_target(spark, d)))


def done_dates(spark, d):
    cells = joins.cells_of_sites(v.grid(spark, d), SITES)
    dates = cells.select("site", F.date_format("time", "yyyyMMdd").alias("date")).distinct()
    dates = written(dates, "dates")
    return joins.pending_dates(dates, dates.filter("cast(date as int) % 3 = 0"))


def _bounds(hours):
    return hours.groupBy("site").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))


def hourly_spine(spark, d):
    hours = written(v.series(spark, d).select("site", "time", "ta_1p5m"), "series")
    return doubles(on_spine(hours, _bounds(hours)))


# Aggregates.
def series_max(spark, d):
    """Every hour of the grid for every site, with NULLs where no cell matched."""
    hours = v.grid(spark, d).select("time").distinct()
    expected = agg.site_hours(hours, SITES)
    return doubles(agg.restore_hours(v.series(spark, d), expected))


def sorted_series(spark, d):
    return doubles(v.series(spark, d)).orderBy("site", "time")


def capacity(spark, d):
    return rounded(agg.capacity(_site_target(spark, d), SITES), "capacity")


def plant_counts(spark, d):
    plants = joins.with_site_columns(_site_target(spark, d), SITES, ["plant_name"])
    return agg.plant_counts(plants)


def mae(spark, d):
    return rounded(agg.mean_absolute_error(v.with_stand_in(v.daily(spark, d))), "mae", places=3)


def weighted_mae(spark, d):
    days = v.with_stand_in(_days(spark, d))
    caps = agg.capacity_by_factor(days, DAY_FACTOR)
    return rounded(
        agg.weighted_mae(joins.attach_per_key(days, caps, ["site"])), "weighted_mae", places=3
    )


def bias(spark, d):
    days = v.with_stand_in(_days(spark, d)).withColumns(calendar_parts("time"))
    train, test = split_rows(days, "month % 2 = 1", "month % 2 = 0")
    return rounded(agg.bias(train, test), "bias", places=3)


# Row order.
def interpolated(spark, d):
    columns = ["ta_1p5m", "pmsl"]
    hours = written(v.series(spark, d).select("site", "time", *columns), "series")
    full = written(on_spine(hours, _bounds(hours)), "spine")
    return rounded(interpolate(full, columns, pos="pos"), *columns)


def interpolated_minutes(spark, d):
    """The same per event type and minute, where gaps remain at any scale."""
    minute = v.table(spark, d, "events").select(
        F.col("event_type").alias("site"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time"),
        F.sqrt("value").alias("value"),
    )
    rows = written(minute.groupBy("site", "time").agg(F.max("value").alias("value")), "minutes")
    full = written(on_spine(rows, _bounds(rows), step_seconds=60), "spine")
    return rounded(interpolate(full, ["value"], pos="pos"), "value")


def interpolated_rows(spark, d):
    """By row position of the rows there are, without a spine."""
    holed = _with_holes(v.series(spark, d).select("site", "time", "ta_1p5m", "pmsl"))
    hours = written(holed.drop("pmsl"), "series")
    return rounded(interpolate(hours, ["ta_1p5m"]), "ta_1p5m")


def _smoothed(window):
    def query(spark, d):
        hours = written(v.series(spark, d).select("site", "time", "pmsl"), "series")
        return rounded(moving_average(doubles(hours), "pmsl", window), "pmsl")

    return query


def fold_id(spark, d):
    days = written(_regimes(spark, d).select("site", "time", "regime"), "regimes")
    return contiguous_folds(days, ["site", "regime"], 3)


# Concatenation.
def unite_strict(spark, d):
    """Each site's cells, one under another."""
    cells = written(joins.cells_of_sites(v.grid(spark, d), SITES), "cells")
    return concat_strict([cells.filter(F.col("site") == s.site) for s in SITES])


def unite_fill(spark, d):
    cells = v.grid(spark, d).select("time", "pmsl")
    return concat_fill([cells, v.target(spark, d)])


# Scalars.
def humidity(spark, d):
    made = physics.absolute_humidity("ta_1p5m", "rh_1p5m")
    return v.series(spark, d).selectExpr("site", "time", f"round({made}, 6) as absolute_humidity")


def density(spark, d):
    made = physics.air_density("pmsl", "ta_1p5m")
    return v.series(spark, d).selectExpr("site", "time", f"round({made}, 6) as air_density")


def wind(spark, d):
    names = [*physics.WIND, *physics.WIND_SQUARED]
    return rounded(physics.wind_features(v.series(spark, d)).select("site", "time", *names), *names)


def direction(spark, d):
    names = [*physics.DIRECTION, *physics.DIRECTION_MIX]
    made = physics.direction_features(physics.wind_features(v.series(spark, d)))
    return rounded(made.select("site", "time", *names), *names)


def turbulence(spark, d):
    made = physics.turbulence_intensity(
        "fvmax_50m", "fvmin_50m", physics.magnitude("uws_10m", "vws_10m")
    )
    return v.series(spark, d).selectExpr(
        "site", "time", f"round({made}, 6) as turbulence_intensity"
    )


def energy(spark, d):
    area = physics.rotor_area("turbine_rad")
    made = physics.wind_energy(
        physics.air_density("pmsl", "ta_1p5m"), area, physics.magnitude("uws_10m", "vws_10m")
    )
    return joins.with_site_columns(v.series(spark, d), SITES, ["turbine_rad"]).selectExpr(
        "site", "time", f"round({area}, 6) as turbine_area", f"round({made}, 6) as wind_energy"
    )


def calendar(spark, d):
    return v.daily(spark, d).select(
        "site", "time", *[c.alias(n) for n, c in calendar_parts("time").items()]
    )


def target_calendar(spark, d):
    made = v.target(spark, d).withColumns(target_parts("end_datetime"))
    return made.withColumn("date", F.col("date").cast("string"))


def parsed_time(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return v.table(spark, d, "events").select("event_id", parse_time(text).alias("time"))


def local_time(spark, d):
    """Event times taken as instants, read on the clock in Seoul."""
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return v.table(spark, d, "events").select(
        "event_id", wall_clock(instant, "Asia/Seoul").alias("time")
    )


def adjusted(spark, d):
    days = v.with_stand_in(_days(spark, d))
    caps = agg.capacity_by_factor(days, DAY_FACTOR)
    made = joins.attach_per_key(days, caps, ["site"]).select(
        "site", "time", uplift_clip("prediction", "capacity", HIGH_DAY_SHARE).alias("energy_kwh")
    )
    return rounded(made, "energy_kwh")


def _paths(spark, d):
    """File paths as a snapshot tree names them; some say no time, some sit in a wrong folder."""
    day = F.date_format("ts", "yyyyMMdd")
    name = F.when(F.col("event_id") % 17 == 0, F.lit("broken")).otherwise(
        F.date_format("ts", "yyyy-MM-dd_HH_mm_ss")
    )
    folder = F.when(F.col("event_id") % 13 == 0, F.lit("20231231")).otherwise(day)
    path = F.concat(F.lit("/root/"), folder, F.lit("/"), name, F.lit(".parquet"))
    return v.table(spark, d, "events").select("event_id", path.alias("path"))


def path_parts(spark, d):
    stem = file_stem("path")
    return _paths(spark, d).select(
        "event_id",
        stem.alias("stem"),
        folder_date_text("path", "/root").alias("folder_date"),
        stem_date_text(stem).alias("name_date"),
    )


def path_guard(spark, d):
    """Events whose path names a time and agrees with its folder."""
    stem = file_stem("path")
    return (
        _paths(spark, d)
        .withColumn("time", stem_time(stem))
        .filter(F.col("time").isNotNull() & (stem_date_text(stem) == folder_date_text("path")))
        .select("event_id", "time")
    )


def tagged(spark, d):
    stem = F.concat(F.lit("wind_farm_"), F.regexp_replace("event_type", "u", "_"))
    return v.table(spark, d, "events").select("event_id", stem_tag(stem).alias("tag"))


def date_text(spark, d):
    return v.daily(spark, d).select("site", "time", compact_date("time").alias("date_text"))


# Files.
def _tree(spark, d):
    root = new_table_dir(spark, "tree")
    snapshots.write_snapshots(v.grid(spark, d), root)
    return root


def tree_scan(spark, d):
    """The grid written as a snapshot tree, scanned between two dates."""
    return snapshots.scan_snapshots(spark, _tree(spark, d), start="2024-01-03", end="2024-01-27")


def tree_series(spark, d):
    """From a snapshot tree to series, with the hours taken from its files."""
    root = _tree(spark, d)
    hours = snapshots.expected_hours(snapshots.list_snapshots(spark, root))
    cells = snapshots.scan_snapshots(spark, root, where=near_any_site(SITES))
    series = agg.site_series(joins.cells_of_sites(cells, SITES))
    return doubles(agg.restore_hours(series, agg.site_hours(hours, SITES)))


def tree_dates(spark, d):
    return snapshots.folder_dates(spark, _tree(spark, d))


def tree_rejects(spark, d):
    """Files of a tree in which some hours lie in another day's folder and some have no time in
    their names, with the reason why they are left out."""
    root = new_table_dir(spark, "tree")
    hour = F.hour("time")
    stem = F.date_format("time", "yyyy-MM-dd_HH_mm_ss")
    (
        v.grid(spark, d)
        .withColumns(
            {
                "day": F.when(hour % 7 == 0, "19991231").otherwise(F.date_format("time", "yyyyMMdd")),
                "hour_file": F.concat(
                    F.when(hour % 7 == 1, F.concat(F.lit("copy-of-"), stem)).otherwise(stem),
                    F.lit(".parquet"),
                ),
            }
        )
        .hint("rebalance", "day", "hour_file")
        .write.partitionBy("day", "hour_file")
        .parquet(root)
    )
    return (
        snapshots.rejected_snapshots(spark, root, footers=True)
        .select(file_stem("path").alias("stem"), "status")
        .distinct()
    )


def schema_profile(spark, d):
    """Files of a grid tree by their columns: three hours have one column more. The few files of a
    group are listed by their hours."""
    root = new_table_dir(spark, "tree")
    cells = v.grid(spark, d)
    odd = "time between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-01-05 02:00:00'"
    snapshots.write_snapshots(cells.filter(f"not ({odd})"), root)
    snapshots.write_snapshots(
        cells.filter(odd).withColumn("gust", F.lit(1.5)), root, mode="append"
    )
    found = snapshots.schema_profile(snapshots.read_catalogue(spark, root))
    stems = F.array_join(F.transform("paths", lambda p: file_stem(p)), ",")
    return found.select("signature", "n_files", stems.alias("stems"))


def late_hours(spark, d):
    """A copy that follows its tree: of dates already copied, every sixth hour comes late."""
    root, path = new_table_dir(spark, "tree"), new_table_dir(spark, "mirror")
    cells = v.grid(spark, d)
    snapshots.write_snapshots(cells.filter("hour(time) % 6 <> 0"), root)
    mirror.refresh(spark, root, SITES, path)
    snapshots.write_snapshots(cells.filter("hour(time) % 6 = 0"), root, mode="append")
    mirror.refresh(spark, root, SITES, path)
    return mirror.read_copied(spark, path)


def mirror_copy(spark, d):
    path = new_table_dir(spark, "mirror")
    snapshots.write_mirror(v.grid(spark, d), SITES, path)
    return snapshots.read_mirror(spark, path)


def mirror_resume(spark, d):
    """A copy made in two runs: odd days first, then whatever is pending."""
    path = new_table_dir(spark, "mirror")
    cells = v.grid(spark, d)
    snapshots.write_mirror(cells.filter("day(time) % 2 = 1"), SITES, path)
    dates = (
        joins.cells_of_sites(cells, SITES)
        .select("site", F.date_format("time", "yyyyMMdd").alias("date"))
        .distinct()
    )
    todo = written(joins.pending_dates(dates, snapshots.done_dates(spark, path)), "pending")
    snapshots.write_mirror(cells, SITES, path, only=todo)
    return snapshots.read_mirror(spark, path)


def series_store(spark, d):
    path = new_table_dir(spark, "series")
    tables.write_series(v.series(spark, d), path, f"{path}-csv")
    return doubles(tables.read_series(spark, path, SITES))


def series_files(spark, d):
    """One file a site under its label, as series come from elsewhere, read in one scan."""
    path = new_table_dir(spark, "series")
    tables.write_series_files(written(v.series(spark, d), "series"), path, SITES)
    return doubles(tables.read_series_files(spark, path, SITES))


def series_csv(spark, d):
    path = new_table_dir(spark, "series")
    hours = v.series(spark, d)
    tables.write_series(hours, path, f"{path}-csv")
    back = spark.read.option("header", True).schema(hours.schema).csv(f"{path}-csv")
    return doubles(back)


def target_store(spark, d):
    """One file per site tag, read back together with the tag taken from the names."""
    path = new_table_dir(spark, "target")
    made = written(v.target(spark, d), "target")
    for s in SITES:
        one = made.filter(F.col("filename") == s.target_tag).drop("filename")
        tables.write_target(one, f"{path}/wind_{s.target_tag}.parquet")
    return tables.read_target(spark, path)


def feature_store(spark, d):
    path = new_table_dir(spark, "features")
    made = v.series(spark, d).select("site", "time", "ta_1p5m", "pmsl")
    tables.write_features(written(made, "series"), path, SITES)
    back, _ = tables.read_features(spark, path, SITES)
    return doubles(back)


def forecast_csv(spark, d):
    path = new_table_dir(spark, "result")
    plants = joins.with_site_columns(_site_target(spark, d), SITES, ["plant_name"])
    tables.write_forecast(
        plants.select(F.col("end_datetime").alias("time"), "energy_kwh", "plant_name"), path
    )
    return tables.read_forecast(spark, path)


# Models. Small settings; the defaults are those of a real run.
DAY_FEATURES = ["n_orders"]
DAY_CALENDAR = ["n_orders", "year", "month", "day"]
LINEAR_TRIES = (("elasticnet", 2.0, 0.25), ("lasso", 50.0, 1.0), ("ridge", 3.0, 0.0))


def linear_slopes(spark, d):
    """One feature, so that each fit has a closed form to compare with."""
    days = assemble(written(v.daily_all(spark, d), "days"), DAY_FEATURES)
    rows = []
    for kind, alpha, mix in LINEAR_TRIES:
        model = fit_linear(days, kind, alpha, mix)
        rows.append((kind, float(model.coefficients[0]), float(model.intercept)))
    fitted = spark.createDataFrame(rows, "kind string, slope double, intercept double")
    return rounded(fitted, "slope", "intercept", places=3)


def _coefficients(kind, alpha, mix):
    def query(spark, d):
        days = v.daily_all(spark, d).withColumns(calendar_parts("time"))
        model = fit_linear(assemble(written(days, "days"), DAY_CALENDAR), kind, alpha, mix)
        rows = [(n, float(w)) for n, w in zip(DAY_CALENDAR, model.coefficients)]
        return rounded(spark.createDataFrame(rows, "feature string, weight double"), "weight", places=3)

    return query


def _tree_scores(kind):
    def query(spark, d):
        days = written(v.daily_all(spark, d).withColumns(calendar_parts("time")), "days")
        train, test = split_rows(days, "month % 2 = 1", "month % 2 = 0")
        estimator = tree_estimator(kind)
        params = tree_params(estimator, {"n_estimators": 5, "max_depth": 4})
        model = estimator.fit(assemble(train, DAY_CALENDAR), params)
        return model.transform(assemble(test, DAY_CALENDAR)).select("site", "time", "prediction")

    return query


def _stump_scores(kind, **settings):
    """Trees of one split on all rows and features, so that each has a closed form."""

    def query(spark, d):
        days = written(v.daily_all(spark, d).withColumns(calendar_parts("time")), "days")
        train, test = split_rows(days, "month % 2 = 1", "month % 2 = 0")
        estimator = tree_estimator(kind).setParams(maxDepth=1, maxBins=128, **settings)
        estimator = estimator.setFeatureSubsetStrategy("all")
        model = estimator.fit(assemble(train, DAY_CALENDAR))
        made = model.transform(assemble(test, DAY_CALENDAR)).select("site", "time", "prediction")
        return rounded(made, "prediction", places=2)

    return query


SEARCH_TRIES = SearchSettings()  # 20 draws for the high regime; 7 (ridge) or 15 for the low one


def _search_scores(kind):
    def query(spark, d):
        """Cross-validated error of each candidate on all features, per regime, and the best."""
        days = _days_with_regime(spark, d).withColumns(calendar_parts("time"))
        ready = written(contiguous_folds(days, ["site", "regime"], 3), "training")
        regimes = usable_regimes(regime_rows(ready), kind, SEARCH_TRIES, other_for_empty=True)
        columns = feature_columns(ready, (*NOT_FEATURES, "capacity", "regime", "fold"))
        found = search(ready, columns, kind, regimes, SEARCH_TRIES)
        rows = [
            (name, n, float(p["alpha"]), float(p.get("l1_ratio", 0.0)), score, int(p is c.params))
            for name, c in found.items()
            for n, (p, score) in enumerate(c.tried)
        ]
        made = spark.createDataFrame(
            rows,
            "regime string, candidate int, alpha double, l1_ratio double, mae double, is_best int",
        )
        return rounded(rounded(made, "alpha", "l1_ratio"), "mae", places=3)

    return query


def _days_with_regime(spark, d):
    days = written(v.daily_all(spark, d), "days")
    caps = agg.capacity_by_factor(days, DAY_FACTOR)
    return written(
        joins.attach_per_key(days, caps, ["site"]).withColumn(
            "regime", regime("energy_kwh", "capacity", HIGH_DAY_SHARE)
        ),
        "days",
    )


TREE_SPACE = {
    "rf": {
        r: {"n_estimators": Whole(3, 9), "max_depth": [2, 5], "max_features": ["sqrt", "log2"]}
        for r in ("high", "low")
    }
}


def forest_search(spark, d):
    days = _days_with_regime(spark, d).withColumns(calendar_parts("time"))
    ready = written(contiguous_folds(days, ["site", "regime"], 3), "training")
    settings = SearchSettings(draws={"high": 3, "low": 3}, spaces=TREE_SPACE)
    regimes = usable_regimes(regime_rows(ready), "rf", settings, other_for_empty=True)
    found = search(ready, DAY_CALENDAR, "rf", regimes, settings)
    rows = [
        (name, n, score) for name, c in found.items() for n, (_, score) in enumerate(c.tried)
    ]
    return spark.createDataFrame(rows, "regime string, candidate int, mae double")


def dual_model(spark, d):
    """Ridge on all features for each regime, all draws, gated; fitted on odd months, for even ones."""
    days = written(v.daily_all(spark, d).withColumns(calendar_parts("time")), "days")
    train, test = split_rows(days, "month % 2 = 1", "month % 2 = 0")
    cap = agg.capacity_by_factor(days, DAY_FACTOR).first().capacity
    columns = feature_columns(days)
    model = fit_dual(train, columns, cap, "ridge", None, HIGH_DAY_SHARE, other_for_empty=True)
    made = model.score(test).select("site", "time", "p_high", "p_low", "prediction")
    return rounded(made, "p_high", "p_low", "prediction", places=2)


def _regular(spark, d):
    made = written(features_of(v.series(spark, d), _site_target(spark, d), SITES), "features")
    return regular_features(made, SITES)


def regular_rows(spark, d):
    """Series, target and features made regular: complete rows or a filled spine."""
    made = _regular(spark, d)
    return rounded(made, *[c for c, t in made.dtypes if t == "double" and c != "energy_kwh"])


def mid_output(spark, d):
    """Regular features stored by site, as the run leaves them for a later one."""
    path = new_table_dir(spark, "mid-output")
    made = _regular(spark, d)
    tables.write_by_site(made, path)
    back = spark.read.parquet(path).withColumn("site", F.col("site").cast("string"))
    return rounded(back, *[c for c, t in back.dtypes if t == "double" and c != "energy_kwh"])


def resume(spark, d):
    """Regular features by a run that is taken up again: from a grid that has grown since its last
    stage, from finished features, and from series where the features were left half written."""
    base = new_table_dir(spark, "run")
    cells = v.grid(spark, d)
    made = written(v.target(spark, d), "target")
    for s in SITES:
        one = made.filter(F.col("filename") == s.target_tag).drop("filename")
        tables.write_target(one, f"{base}/target/wind_{s.target_tag}.parquet")
    run = SiteForecast(spark, base, SITES, csv=False)
    snapshots.write_snapshots(cells.filter("day(time) < 20"), run.grid)
    run.resume_features()
    snapshots.write_snapshots(cells.filter("day(time) >= 20"), run.grid, mode="append")
    taken = []
    for _ in range(3):
        stage = run.latest_stage()
        rows = written(run.resume_features(), "resumed")
        taken.append(rows.select(F.lit(stage).alias("stage"), "site", "time", "energy_kwh", "pmsl", "wind_speed"))
        if stage == "features":
            run.stages.begin("features", "cut off")
    return rounded(concat_fill(taken), "pmsl", "wind_speed")


def site_forecast(spark, d):
    """All sites from grid cells to smoothed forecasts, by odd and even days: all features, all
    draws, all sites in one pass."""
    rows = written(_regular(spark, d), "regular")
    models = fit_many(
        rows.filter(rows_where(SITES, "train_when")),
        feature_columns(rows),
        agg.capacity(rows, SITES),
        {s.site: s.model_type for s in SITES},
        other_for_few=True,
    )
    scored = models.score(rows.filter(rows_where(SITES, "test_when")))
    plants = joins.with_site_columns(scored, SITES, ["plant_name"]).select(
        "site", "time", uplift_clip("prediction", "capacity").alias("energy_kwh"), "plant_name"
    )
    smooth = moving_average(written(plants, "scored"), "energy_kwh", SMOOTHING)
    return rounded(smooth, "energy_kwh", places=2)


# Stream.
def _put_damaged(spark, paths):
    """Files with a Parquet name and nothing of one within, written by the executors."""

    def write(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                filesystem, inner = fs.FileSystem.from_uri(path)
                filesystem.create_dir(inner.rsplit("/", 1)[0])
                with filesystem.open_output_stream(inner) as out:
                    out.write(b"no Parquet")
            yield batch

    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    rows.mapInPandas(write, "path string").collect()


def stream_ingest(spark, d):
    """The grid as a tree of hourly files, taken in as a stream of new files, in two runs; one file of
    each half is damaged and goes to quarantine."""
    names = ("tree", "stream", "checkpoint", "quarantine")
    root, mirror_path, checkpoint, aside = (new_table_dir(spark, n) for n in names)
    cells = v.grid(spark, d)
    for part, bad in (("<", "20240101/2024-01-01_00_30_00"), (">=", "20240120/2024-01-20_00_30_00")):
        snapshots.write_snapshots(cells.filter(f"day(time) {part} 16"), root, mode="append")
        _put_damaged(spark, [f"{root}/{bad}.parquet"])
        stream.ingest_tree(
            spark, root, SITES, mirror_path, checkpoint, aside, files_per_batch=200
        ).awaitTermination()
    taken = stream.ingested(spark, mirror_path)
    left = spark.read.parquet(aside).select(
        F.lit("(quarantine)").alias("site"), stem_time(file_stem("path")).alias("time")
    )
    return taken.unionByName(left, allowMissingColumns=True)


QUERIES: dict[str, Query] = {
    "site_features": site_features,
    "bbox_filter": bbox_filter,
    "date_range": date_range,
    "site_filter": site_filter,
    "numeric_cast": numeric_cast,
    "literal_cols": literal_cols,
    "drop_cols": drop_cols,
    "feature_cols": feature_cols,
    "exclude_time": exclude_time,
    "drop_missing": drop_missing,
    "year_split": year_split,
    "month_parity_split": month_parity_split,
    "regime_split": regime_split,
    "regime_counts": regime_counts,
    "site_grid_join": site_grid_join,
    "site_lookup": site_lookup,
    "target_join": target_join,
    "done_dates": done_dates,
    "hourly_spine": hourly_spine,
    "series_max": series_max,
    "sorted_series": sorted_series,
    "capacity": capacity,
    "plant_counts": plant_counts,
    "mae": mae,
    "weighted_mae": weighted_mae,
    "bias": bias,
    "interpolate": interpolated,
    "interpolate_minutes": interpolated_minutes,
    "interpolate_rows": interpolated_rows,
    "smooth_3": _smoothed(3),
    "smooth_5": _smoothed(5),
    "fold_id": fold_id,
    "concat_strict": unite_strict,
    "concat_fill": unite_fill,
    "humidity": humidity,
    "density": density,
    "wind": wind,
    "direction": direction,
    "turbulence": turbulence,
    "energy": energy,
    "calendar": calendar,
    "target_calendar": target_calendar,
    "parse_time": parsed_time,
    "local_time": local_time,
    "uplift_clip": adjusted,
    "path_parts": path_parts,
    "path_guard": path_guard,
    "stem_tag": tagged,
    "date_text": date_text,
    "tree_scan": tree_scan,
    "tree_series": tree_series,
    "tree_dates": tree_dates,
    "tree_rejects": tree_rejects,
    "schema_profile": schema_profile,
    "late_hours": late_hours,
    "mirror_copy": mirror_copy,
    "mirror_resume": mirror_resume,
    "series_store": series_store,
    "series_csv": series_csv,
    "series_files": series_files,
    "target_store": target_store,
    "feature_store": feature_store,
    "forecast_csv": forecast_csv,
    "linear_slopes": linear_slopes,
    "elastic_net": _coefficients("elasticnet", 2.0, 0.25),
    "lasso": _coefficients("lasso", 50.0, 1.0),
    "ridge": _coefficients("ridge", 3.0, 0.0),
    "forest": _tree_scores("rf"),
    "boosted": _tree_scores("xgb"),
    "stump_forest": _stump_scores("rf", numTrees=3, bootstrap=False),
    "stump_boost": _stump_scores("xgb", maxIter=3, stepSize=0.1),
    "search_scores": _search_scores("ridge"),
    "search_net": _search_scores("elasticnet"),
    "forest_search": forest_search,
    "dual_model": dual_model,
    "regular_rows": regular_rows,
    "mid_output": mid_output,
    "resume": resume,
    "site_forecast": site_forecast,
    "stream_ingest": stream_ingest,
}
