"""Aggregates. All are max, sum or count, so Spark combines them before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windspan.functions.missing import nan_to_null
from windspan.functions.output import weighted_error
from windspan.operators.joins import with_site_columns
from windspan.operators.selection import numeric_projection
from windspan.sites import Site


def largest(df: DataFrame, *names: str) -> list[Column]:
    """max() of each column, passing over NaN."""
    kinds = dict(df.dtypes)

    def text(c: str) -> str:
        value = f"`{c}`"
        if kinds[c] in ("double", "float"):
            value = f"nullif({value}, cast('NaN' as {kinds[c]}))"
        return f"max({value}) as `{c}`"

    return [F.expr(text(c)) for c in names]


def site_series(cells: DataFrame, keys: Sequence[str] = ("site", "time")) -> DataFrame:
    """One row per site and hour: the maximum of every numeric column, doubles as float."""
    narrow = numeric_projection(cells, keep=keys)
    return narrow.groupBy(*keys).agg(*largest(narrow, *[c for c in narrow.columns if c not in keys]))


def site_hours(hours: DataFrame, sites: Sequence[Site], dated=True) -> DataFrame:
    """The hours each site should have: all of `hours`, or those within the site's dates."""
    return for_sites(hours, sites, dated).select("time", "site")


def for_sites(rows: DataFrame, sites: Sequence[Site], dated=True) -> DataFrame:
    """Rows with a `time`, once for every site, or for every site within whose dates they are."""
    wanted = F.array(
        *[
            F.struct(
                F.lit(s.site).alias("site"),
                F.lit(s.start_date).cast("date").alias("lo"),
                F.lit(s.end_date).cast("date").alias("hi"),
            )
            for s in sites
        ]
    )
    if dated:
        day = F.to_date("time")
        wanted = F.filter(wanted, lambda s: day.between(s["lo"], s["hi"]))
    return rows.select("*", F.explode(F.transform(wanted, lambda s: s["site"])).alias("site"))


def restore_hours(series: DataFrame, expected: DataFrame) -> DataFrame:
    """Give hours without a single matching cell a row of NULLs. No hour of `series` goes."""
    return expected.select("site", "time").join(series, ["site", "time"], "full")


def capacity(df: DataFrame, sites: Sequence[Site], value="energy_kwh") -> DataFrame:
    """Estimated capacity per site: the largest output times the site's factor."""
    peak = df.groupBy("site").agg(*largest(df, value))
    return with_site_columns(peak, sites, ["capacity_factor"]).selectExpr(
        "site", f"{value} * capacity_factor as capacity"
    )


def capacity_by_factor(df: DataFrame, factor: float, value="energy_kwh") -> DataFrame:
    """The same for data without a site list."""
    return df.groupBy("site").agg((F.max(nan_to_null(value)) * factor).alias("capacity"))


def plant_counts(forecast: DataFrame) -> DataFrame:
    """Forecasts per plant, and of all plants together in the row without a name."""
    return (
        forecast.rollup("plant_name")
        .agg(F.count(F.lit(1)).alias("n_forecasts"), F.grouping("plant_name").alias("_all"))
        .withColumn("plant_name", F.when(F.col("_all") == 1, "(total)").otherwise(F.col("plant_name")))
        .drop("_all")
    )


def regime_counts(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("regime").isNotNull())
        .groupBy("site", "regime")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def mean_absolute_error(df: DataFrame, y="energy_kwh", p="prediction", by=("site",)) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))


def weighted_mae(
    df: DataFrame, y="energy_kwh", p="prediction", capacity="capacity", by=("site",)
) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(weighted_error(y, p, capacity)).alias("weighted_mae"))


def bias(train: DataFrame, scored: DataFrame, y="energy_kwh", p="prediction") -> DataFrame:
    """Mean of the training output less mean of the forecast, per site; NULL for a site with only
    one of them."""
    actual = train.groupBy("site").agg(F.avg(y).alias("_actual"))
    forecast = scored.groupBy("site").agg(F.avg(p).alias("_forecast"))
    return actual.join(forecast, "site", "full").select(
        "site", (F.col("_actual") - F.col("_forecast")).alias("bias")
    )
