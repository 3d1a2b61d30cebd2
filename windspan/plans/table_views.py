"""Grid, target and daily views over the given tables, and the sites to use with them."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windspan.operators.aggregates import site_series
from windspan.operators.joins import cells_of_sites
from windspan.sites import DEFAULT_SITES

# The given tables' cells are 0.2 degrees apart and all lie in January 2024.
SITES = tuple(
    dataclasses.replace(
        s,
        lat_range=0.5,
        lon_range=0.7,
        start_date="2024-01-01",
        end_date="2024-01-31",
        excluded_time="2024-01-01 00:00:00",
        spine_start="2024-01-01 01:00:00" if s.gaps == "interpolate" else None,
        spine_end="2024-01-30 23:00:00" if s.gaps == "interpolate" else None,
        train_when="day % 2 = 1",
        test_when="day % 2 = 0",
        model_type="elasticnet",
    )
    for s in DEFAULT_SITES
)

_HOUR = "cast(date_trunc('hour', ts) as timestamp_ntz)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_grid(events: DataFrame) -> DataFrame:
    return events.filter("event_type <> 'purchase'").selectExpr(
        f"{_HOUR} as time",
        "35.0e0 + (user_id % 15) * 0.2e0 as latitude",
        "128.5e0 + (user_id % 7) * 0.2e0 as longitude",
        "268.15e0 + value % 40 as ta_1p5m",
        "20e0 + event_id % 80 as rh_1p5m",
        "990e0 + event_id % 50 as pmsl",
        "(event_id % 31) - 14.5e0 as uws_10m",
        "(event_id % 23) - 10.75e0 as vws_10m",
        "value / 100 as fvmin_50m",
        "value / 100 + event_id % 7 as fvmax_50m",
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_grid(table(spark, sf_dir, "events"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .filter("event_type = 'purchase'")
        .selectExpr(
            "case user_id % 3 when 0 then 'gyeongju' when 1 then 'yangyang' else 'yeongduk' end"
            " as filename",
            f"{_HOUR} as end_datetime",
            "value",
        )
        .groupBy("filename", "end_datetime")
        .agg((F.max("value") * 100).alias("energy_kwh"))
    )


def _per_day(orders: DataFrame) -> DataFrame:
    return orders.groupBy("site", "time").agg(
        F.max("o_totalprice").alias("energy_kwh"), F.count(F.lit(1)).alias("n_orders")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_day(
        table(spark, sf_dir, "orders").selectExpr(
            "o_orderpriority as site", "o_orderdate as time", "o_totalprice"
        )
    )


def daily_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all priorities, as one site."""
    return _per_day(
        table(spark, sf_dir, "orders").selectExpr(
            "'all' as site", "o_orderdate as time", "o_totalprice"
        )
    )


def with_stand_in(days: DataFrame) -> DataFrame:
    """Daily rows with a stand-in forecast."""
    return days.selectExpr("*", "energy_kwh * 0.9e0 + 1000 * n_orders as prediction")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_series(cells_of_sites(grid(spark, sf_dir), SITES))


def doubles(df: DataFrame) -> DataFrame:
    """Floats as doubles, for comparison."""
    return df.selectExpr(
        *[f"cast({c} as double) as {c}" if t == "float" else c for c, t in df.dtypes]
    )


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.selectExpr(
        *[f"round(cast({c} as double), {places}) as {c}" if c in names else c for c in df.columns]
    )
