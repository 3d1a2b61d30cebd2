"""Site configuration: where a site is, what it runs on, and how it is forecast."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A site list is written out by hand, so its length is known before any plan is built. Up to
# this many rows it may be broadcast; beyond, callers use a shuffled join.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Site:
    site: str
    label: str
    plant_name: str
    short: str
    target_tag: str
    lat: float
    lon: float
    lat_range: float
    lon_range: float
    start_date: str
    end_date: str
    turbine_rad: float
    capacity_factor: float
    tz: str = "Asia/Seoul"
    # "drop": rows with a missing feature go. "interpolate": every hour from spine_start to
    # spine_end is present and gaps are filled.
    gaps: str = "drop"
    excluded_time: str | None = None
    spine_start: str | None = None
    spine_end: str | None = None
    model_type: str = "rf"
    train_when: str = "true"
    test_when: str = "true"

    @property
    def box(self) -> tuple[float, float, float, float]:
        return (
            self.lat - self.lat_range,
            self.lat + self.lat_range,
            self.lon - self.lon_range,
            self.lon + self.lon_range,
        )


# The three wind farms, their boxes, dates, rotors, capacity factors and splits.
DEFAULT_SITES = (
    Site(
        site="gyeongju",
        label="경주",
        plant_name="경주풍력",
        short="gy",
        target_tag="gyeongju",
        lat=35.7149,
        lon=129.3693,
        lat_range=0.015,
        lon_range=0.015,
        start_date="2020-01-01",
        end_date="2024-12-31",
        turbine_rad=56.5,
        capacity_factor=1.04,
        gaps="drop",
        excluded_time="2020-01-01 00:00:00",
        model_type="rf",
        train_when="year <= 2023",
        test_when="year = 2024",
    ),
    Site(
        site="yeongdeok",
        label="영덕",
        plant_name="영덕풍력",
        short="yd",
        target_tag="yeongduk",
        lat=36.4198685,
        lon=129.3960048,
        lat_range=0.015,
        lon_range=0.015,
        start_date="2024-04-01",
        end_date="2025-03-31",
        turbine_rad=75.5,
        capacity_factor=1.05,
        gaps="interpolate",
        spine_start="2024-04-01 00:00:00",
        spine_end="2025-03-31 23:00:00",
        model_type="elasticnet",
        train_when="month % 2 = 1",
        test_when="month % 2 = 0",
    ),
    Site(
        site="yangyang",
        label="양양",
        plant_name="양양풍력",
        short="yy",
        target_tag="yangyang",
        lat=37.9330943,
        lon=128.6943946,
        lat_range=0.02,
        lon_range=0.02,
        start_date="2024-04-01",
        end_date="2025-03-31",
        turbine_rad=67.85,
        capacity_factor=1.05,
        gaps="interpolate",
        excluded_time="2024-04-01 00:00:00",
        spine_start="2024-04-01 01:00:00",
        spine_end="2025-03-31 23:00:00",
        model_type="elasticnet",
        train_when="month % 2 = 0",
        test_when="month % 2 = 1",
    ),
)

def check_sites(sites: Sequence[Site]) -> None:
    """Names and tags are join keys, so each must be unique."""
    if not sites:
        raise ValueError("no sites")
    for field in ("site", "target_tag"):
        values = [getattr(s, field) for s in sites]
        if len(set(values)) != len(values):
            raise ValueError(f"duplicate {field} in the site list")
    for s in sites:
        if s.lat_range < 0 or s.lon_range < 0:
            raise ValueError(f"negative box for site {s.site}")
        if s.gaps not in ("drop", "interpolate"):
            raise ValueError(f"unknown gap treatment for site {s.site}: {s.gaps}")
        if s.gaps == "interpolate" and not (s.spine_start and s.spine_end):
            raise ValueError(f"site {s.site} needs spine_start and spine_end")


def sites_frame(spark: SparkSession, sites: Sequence[Site] = DEFAULT_SITES) -> DataFrame:
    """The site list as a local table of known size."""
    check_sites(sites)
    south, north, west, east = zip(*(s.box for s in sites))
    table = pa.table(
        {
            "site": pa.array([s.site for s in sites], pa.string()),
            "plant_name": pa.array([s.plant_name for s in sites], pa.string()),
            "target_tag": pa.array([s.target_tag for s in sites], pa.string()),
            "lat_min": pa.array(south, pa.float64()),
            "lat_max": pa.array(north, pa.float64()),
            "lon_min": pa.array(west, pa.float64()),
            "lon_max": pa.array(east, pa.float64()),
            "start_date": pa.array([dt.date.fromisoformat(s.start_date) for s in sites]),
            "end_date": pa.array([dt.date.fromisoformat(s.end_date) for s in sites]),
            "turbine_rad": pa.array([s.turbine_rad for s in sites], pa.float64()),
            "capacity_factor": pa.array([s.capacity_factor for s in sites], pa.float64()),
            "tz": pa.array([s.tz for s in sites], pa.string()),
        }
    )
    return spark.createDataFrame(table)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast `df` if its row bound allows it, else leave the choice of join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def site_named(sites: Sequence[Site], name: str) -> Site:
    for s in sites:
        if s.site == name:
            return s
    raise ValueError(f"unknown site: {name}")
