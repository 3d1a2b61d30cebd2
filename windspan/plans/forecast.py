"""The whole run, from grid files to forecasts, in stages that can be resumed.

Each stage ends in a written table, so a later stage scans files instead of recomputing the
earlier ones, and a run can start at the last stage that was reached.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windspan.functions.clock import calendar_parts
from windspan.functions.output import HIGH_SHARE, uplift_clip
from windspan.functions.physics import derived_features
from windspan.operators.aggregates import (
    capacity,
    restore_hours,
    site_hours,
    site_series,
)
from windspan.operators.dual import DualModel, fit_dual
from windspan.operators.gaps import interpolate, on_spine, spine_bounds
from windspan.operators.joins import (
    cells_of_sites,
    join_target,
    with_site_columns,
)
from windspan.operators.many import LinearSite, fit_many
from windspan.operators.models import LINEAR, PREDICTION
from windspan.operators.rows import moving_average
from windspan.operators.search import SearchSettings
from windspan.operators.selection import (
    JOIN_LEFTOVERS,
    drop_incomplete,
    exclude_times,
    feature_columns,
    near_any_site,
    split_rows,
)
from windspan.operators.unions import concat_fill
from windspan.plans.stages import StageLog, listing_mark, mark
from windspan.session import side_by_side, written
from windspan.sites import DEFAULT_SITES, Site, check_sites
from windspan.sources import mirror
from windspan.sources.snapshots import (
    expected_hours,
    list_snapshots,
    read_catalogue,
    scan_snapshots,
)
from windspan.sources.tables import (
    if_present,
    list_files,
    localise_target,
    read_features,
    read_series,
    read_series_files,
    read_target,
    write_by_site,
    write_features,
    write_forecast,
    write_series,
    write_target,
)

SMOOTHING = 5


def within_dates(cells: DataFrame, sites: Sequence[Site]) -> DataFrame:
    """Each site's cells within the site's dates."""
    dated = with_site_columns(cells, sites, ["start_date", "end_date"])
    return dated.filter(F.to_date("time").between(F.col("start_date"), F.col("end_date"))).drop(
        "start_date", "end_date"
    )


def series_of(cells: DataFrame, hours: DataFrame | None, sites: Sequence[Site]) -> DataFrame:
    """Cells of all sites to one hourly series per site; empty hours are kept if known."""
    series = site_series(within_dates(cells_of_sites(cells, sites), sites))
    return series if hours is None else restore_hours(series, site_hours(hours, sites))


def features_of(series: DataFrame, target: DataFrame, sites: Sequence[Site]) -> DataFrame:
    """Series, measured output and derived features."""
    output = target.drop(*[c for c in JOIN_LEFTOVERS if c != "end_datetime"])
    joined = with_site_columns(join_target(series, output), sites, ["turbine_rad"])
    return derived_features(joined)


def rows_where(sites: Sequence[Site], field: str) -> Column:
    """Rows that meet their own site's condition, `train_when` or `test_when`."""
    by_text: dict[str, list[str]] = {}
    for s in sites:
        by_text.setdefault(getattr(s, field), []).append(s.site)
    met = F.lit(False)
    for text, names in by_text.items():
        met = met | (F.col("site").isin(names) & F.expr(text))
    return met


def regular_features(
    features: DataFrame, sites: Sequence[Site], calendar: str = "time"
) -> DataFrame:
    """Complete rows for some sites, a filled hourly spine for the others.

    `calendar="time"` takes year, month, day and hour from each row's time;
    `"interpolate"` draws them along the line like any other column.
    """
    if calendar not in ("time", "interpolate"):
        raise ValueError(f"unknown calendar: {calendar}")
    if calendar == "time":
        features = features.drop(*calendar_parts("time"))  # set below, so not drawn along the line
    numbers = feature_columns(features)
    features = exclude_times(
        features.withColumns({c: F.col(f"`{c}`").cast("double") for c in numbers}),
        {s.site: s.excluded_time for s in sites if s.excluded_time},
    )
    order = ["site", "time", *numbers, "energy_kwh"]
    parts = []
    dropped = [s.site for s in sites if s.gaps == "drop"]
    if dropped:
        parts.append(drop_incomplete(features.filter(F.col("site").isin(dropped))).select(*order))
    if len(dropped) < len(sites):
        gappy = features.filter(~F.col("site").isin(dropped)) if dropped else features
        # Read twice by the interpolation, so the spine join is not done twice.
        full = written(on_spine(gappy, spine_bounds(features.sparkSession, sites)), "spine")
        parts.append(interpolate(full, numbers, pos="pos").select(*order))
    made = concat_fill(parts)
    return made.withColumns(calendar_parts("time")) if calendar == "time" else made


class SiteForecast:
    """All stages over one working folder.

    `grid`, `target`, `results` and `features` name its sub-folders. Give `schema`, the grid
    files' columns, where runs are frequent: without it every footer of the tree is read to
    find out.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        sites: Sequence[Site] = DEFAULT_SITES,
        *,
        grid: str = "ldaps",
        target: str = "target",
        results: str = "results",
        features: str = "파생변수추가된데이터",
        schema: T.StructType | None = None,
        settings: SearchSettings | None = None,
        share: float = HIGH_SHARE,
        calendar: str = "time",
        capacity_from: str = "all",
        target_pattern: str | None = None,
        mirror: bool = False,
        csv: bool = True,
        other_for_empty: bool = False,
    ):
        check_sites(sites)
        if capacity_from not in ("all", "train"):
            raise ValueError(f"unknown capacity_from: {capacity_from}")
        base = base.rstrip("/")
        self.spark, self.sites = spark, tuple(sites)
        self.grid, self.target = f"{base}/{grid}", f"{base}/{target}"
        self.results, self.features = f"{base}/{results}", f"{base}/{features}"
        self.schema, self.settings, self.share = schema, settings or SearchSettings(), share
        self.calendar, self.capacity_from = calendar, capacity_from
        self.target_pattern, self.mirror, self.csv = target_pattern, mirror, csv
        self.other_for_empty = other_for_empty
        self.series_path = f"{self.results}/series"
        self.stages = StageLog(spark, f"{self.results}/stages")
        self.models: dict[str, DualModel | LinearSite] = {}

    # Stage 1: grid files to series.
    def refresh_mirror(self) -> str:
        """Copy the cells of files not copied yet, late hours of copied dates among them."""
        path = f"{self.results}/mirror"
        mirror.refresh(self.spark, self.grid, self.sites, path, self.schema)
        return path

    def build_series(self) -> DataFrame:
        inputs = self._series_inputs()
        run = self.stages.begin("series", inputs)
        start = min(s.start_date for s in self.sites)
        end = max(s.end_date for s in self.sites)
        if self.mirror:
            path = self.refresh_mirror()
            cells = mirror.read_copied(self.spark, path).drop("date")
            series = restore_hours(
                site_series(within_dates(cells, self.sites)), mirror.copied_hours(self.spark, path)
            )
        else:
            files = read_catalogue(self.spark, self.grid, start, end)
            cells = scan_snapshots(
                self.spark, self.grid, self.schema, where=near_any_site(self.sites), catalogue=files
            )
            series = series_of(cells, expected_hours(files), self.sites)
        write_series(series, self.series_path, f"{self.series_path}_csv" if self.csv else None)
        self.stages.finish("series", inputs, run)
        return self.load_series()

    def load_series(self) -> DataFrame:
        """The stored series, or else one file a site, as `{label}_test/{label}_timeseries_MAX.parquet`
        among the results."""
        if if_present(lambda: self.spark.read.parquet(self.series_path)) is not None:
            return read_series(self.spark, self.series_path, self.sites)
        return read_series_files(self.spark, self.results, self.sites)

    def load_target(self) -> DataFrame:
        """Measured output of the sites. All target rows are stored, those of other tags without a
        site."""
        target = localise_target(
            read_target(self.spark, self.target, self.target_pattern, self.sites), self.sites, True
        )
        path = f"{self.results}/target.parquet"
        write_target(target, path)
        stored = self.spark.read.schema(target.schema).parquet(path)
        return stored.filter("site is not null")

    # Stage 2: series and target to regular features.
    def build_features(self, series: DataFrame, target: DataFrame) -> DataFrame:
        joined = written(features_of(series, target, self.sites), "features")
        regular = regular_features(joined, self.sites, self.calendar)
        path = f"{self.results}/mid_output"
        write_by_site(regular, path)
        return self.load_features()

    def load_features(self) -> DataFrame:
        stored = self.spark.read.parquet(f"{self.results}/mid_output")
        return stored.withColumn("site", F.col("site").cast("string"))

    def publish_features(self, features: DataFrame) -> None:
        """Store features where a later run with `use_processed_data` looks for them."""
        write_features(features, self.features, self.sites)

    # What stages are made from.
    def _series_inputs(self) -> str:
        """The grid's files; or, where there is no grid, the stored series themselves."""
        files = if_present(lambda: list_snapshots(self.spark, self.grid))
        if files is None:
            return "given"
        return mark(listing_mark(files, self.grid), self.sites, self.schema and self.schema.json())

    def _feature_inputs(self) -> str:
        files = if_present(lambda: list_files(self.spark, self.target))
        target = "none" if files is None else listing_mark(files, self.target)
        return mark(self._series_inputs(), target, self.calendar, self.target_pattern, self.sites)

    def _staged_features(self, series: Callable[[], DataFrame]) -> DataFrame:
        inputs = self._feature_inputs()
        run = self.stages.begin("features", inputs)
        made = self.build_features(series(), self.load_target())
        self.stages.finish("features", inputs, run)
        return made

    def latest_stage(self) -> str:
        """The stage a resumed run starts from: "finished" features given from outside, regular
        "features", "series", or the "grid"."""
        if read_features(self.spark, self.features, self.sites)[0] is not None:
            return "finished"
        if self.stages.finished("features", self._feature_inputs()):
            return "features"
        inputs = self._series_inputs()
        if inputs == "given" or self.stages.finished("series", inputs):
            return "series"
        return "grid"

    def resume_features(self) -> DataFrame:
        """Regular features, made from the latest stage that is whole and up to date."""
        stage = self.latest_stage()
        if stage == "finished":
            return read_features(self.spark, self.features, self.sites)[0]
        if stage == "features":
            return self.load_features()
        return self._staged_features(self.load_series if stage == "series" else self.build_series)

    # Stage 3: features to forecasts.
    def fit_and_score(self, features: DataFrame) -> DataFrame:
        columns = feature_columns(features)
        linear = [s for s in self.sites if s.model_type in LINEAR]
        trees = [s for s in self.sites if s.model_type not in LINEAR]
        scored = [self._linear_sites(features, linear, columns)] if linear else []
        if trees:
            caps = {r.site: r.capacity for r in capacity(features, trees).collect()}
            scored += side_by_side(
                self.spark,
                lambda s: self._tree_site(features, s, caps.get(s.site), columns),
                trees,
                self.settings.parallelism,
            )
        forecast = written(concat_fill(scored), "scored")
        return moving_average(forecast, "energy_kwh", SMOOTHING).select(
            "time", "energy_kwh", "plant_name"
        )

    def _linear_sites(
        self, features: DataFrame, sites: Sequence[Site], columns: Sequence[str]
    ) -> DataFrame:
        """All sites with linear models, in as many jobs as one site takes."""
        train = features.filter(rows_where(sites, "train_when"))
        test = features.filter(rows_where(sites, "test_when"))
        rows = train if self.capacity_from == "train" else features.filter(
            F.col("site").isin([s.site for s in sites])
        )
        models = fit_many(
            train,
            columns,
            capacity(rows, sites),
            {s.site: s.model_type for s in sites},
            self.settings,
            self.share,
            self.other_for_empty,
        )
        self.models.update(models.by_site())
        named = with_site_columns(models.score(test), sites, ["plant_name"])
        return named.select(
            "site",
            "time",
            uplift_clip(PREDICTION, "capacity", self.share).alias("energy_kwh"),
            "plant_name",
        )

    def _tree_site(
        self, features: DataFrame, s: Site, cap: float | None, columns: Sequence[str]
    ) -> DataFrame:
        rows = features.filter(F.col("site") == s.site)
        train, test = split_rows(rows, s.train_when, s.test_when)
        if self.capacity_from == "train":
            cap = capacity(train, [s]).first().capacity
        known = self._known_columns(rows, columns)
        model = fit_dual(
            train, known, cap, s.model_type, self.settings, self.share, self.other_for_empty
        )
        self.models[s.site] = model
        return model.score(test).select(
            "site",
            "time",
            uplift_clip(PREDICTION, F.lit(cap), self.share).alias("energy_kwh"),
            F.lit(s.plant_name).alias("plant_name"),
        )

    @staticmethod
    def _known_columns(rows: DataFrame, columns: Sequence[str]) -> list[str]:
        """Columns this site has at all; sites stored apart need not have the same ones."""
        counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)])
        return [c for c, n in zip(columns, counts.first()) if n > 0]

    def write_result(self, forecast: DataFrame) -> DataFrame:
        path = f"{self.results}/result.csv"
        write_forecast(forecast, path)
        return self.spark.read.option("header", True).schema(forecast.schema).csv(path)

    def run(
        self, skip_weather_processing: bool = True, use_processed_data: bool = True
    ) -> DataFrame:
        """Start at the latest stage asked for and present; earlier ones where it is not."""
        if use_processed_data:
            features, _ = read_features(self.spark, self.features, self.sites)
            if features is not None:
                return self.write_result(self.fit_and_score(features))
        series = self.load_series if skip_weather_processing else self.build_series
        return self.write_result(self.fit_and_score(self._staged_features(series)))

    def resume(self) -> DataFrame:
        """Run from the latest stage that is whole and made from the inputs as they are now."""
        return self.write_result(self.fit_and_score(self.resume_features()))
