"""Whole runs on a small tree: all three starting points, and the resumed copy."""

import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from trees import site_maxima, tree

from windspan.functions.output import HIGH, LOW
from windspan.operators.search import SearchSettings
from windspan.operators.selection import near_any_site
from windspan.plans.forecast import SiteForecast, regular_features
from windspan.plans.table_views import SITES
from windspan.sources.tables import if_present
from windspan.streaming.ingest import ingest, ingest_tree, ingested, snapshot_stream

START, END = "2024-01-01 00:00", "2024-01-08 23:00"
GAPS = ("2024-01-03 05:00:00", "2024-01-03 06:00:00", "2024-01-08 23:00:00")
RUN_SITES = tuple(
    dataclasses.replace(
        s,
        start_date="2024-01-01",
        end_date="2024-01-08",
        spine_start="2024-01-01 01:00:00" if s.gaps == "interpolate" else None,
        spine_end="2024-01-08 23:00:00" if s.gaps == "interpolate" else None,
    )
    for s in SITES
)
SETTINGS = SearchSettings(draws={HIGH: 2, LOW: 2})


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    hours = tree(root / "ldaps", START, END, skip=GAPS)
    rng = np.random.default_rng(3)
    for s in RUN_SITES:
        at = pd.date_range(START, END, freq="h")
        frame = pd.DataFrame(
            {
                "end_datetime": at.tz_localize("Asia/Seoul").astype("datetime64[us, Asia/Seoul]"),
                "energy_kwh": rng.uniform(0, 5000, len(at)),
                "plant_name": "p",
            }
        )
        (root / "target").mkdir(exist_ok=True)
        pq.write_table(pa.Table.from_pandas(frame), root / "target" / f"wind_{s.target_tag}.parquet")
    return root, hours


@pytest.fixture(scope="module")
def run(spark, base):
    return SiteForecast(spark, str(base[0]), RUN_SITES, settings=SETTINGS)


@pytest.fixture(scope="module")
def first(run):
    return run.run(skip_weather_processing=False, use_processed_data=False).toPandas()


def by_row(df):
    return df.sort_values(["plant_name", "time"], ignore_index=True)


def test_from_grid_files(spark, base, run, first):
    made = run.load_series().toPandas().sort_values(["site", "time"], ignore_index=True)
    want = site_maxima(base[1], RUN_SITES).sort_values(["site", "time"], ignore_index=True)
    pd.testing.assert_frame_equal(made[want.columns], want, check_dtype=False)

    features = spark.read.parquet(f"{base[0]}/results/mid_output").toPandas()
    counts = features.groupby("site").size().to_dict()
    # Complete rows less the excluded hour; or every hour of the spine.
    assert counts == {"gyeongju": 192 - 3 - 1, "yeongdeok": 191, "yangyang": 191}
    full = features[features.site != "gyeongju"]
    assert full.pmsl.notna().all() and full.time.notna().all()
    assert (full.hour == full.time.dt.hour).all()

    assert list(first.columns) == ["time", "energy_kwh", "plant_name"]
    per_plant = first.groupby("plant_name").size().to_dict()
    even = features[features.day % 2 == 0].groupby("site").size().to_dict()
    assert per_plant == {s.plant_name: even[s.site] for s in RUN_SITES}
    for s in RUN_SITES:
        cap = run.models[s.site].capacity
        part = first[first.plant_name == s.plant_name]
        assert part.energy_kwh.between(0, cap).all()


def test_from_series(run, first):
    again = run.run(skip_weather_processing=True, use_processed_data=False).toPandas()
    pd.testing.assert_frame_equal(by_row(again), by_row(first), rtol=1e-6)


def test_from_features(spark, base, run, first):
    run.publish_features(spark.read.parquet(f"{base[0]}/results/mid_output"))
    again = run.run(use_processed_data=True).toPandas()
    pd.testing.assert_frame_equal(by_row(again), by_row(first), rtol=1e-6)


def test_resume(spark, base, first):
    """With neither features nor series, the run starts at the grid files."""
    fresh = SiteForecast(
        spark, str(base[0]), RUN_SITES, results="fresh", features="none", settings=SETTINGS, csv=False
    )
    made = by_row(fresh.resume().toPandas())
    pd.testing.assert_frame_equal(made, by_row(first), rtol=1e-6)
    assert if_present(lambda: spark.read.parquet(fresh.series_path)) is not None


def test_capacity_from_training_rows(spark, base, first):
    some = SiteForecast(
        spark, str(base[0]), RUN_SITES, results="train", settings=SETTINGS, capacity_from="train"
    )
    features = spark.read.parquet(f"{base[0]}/results/mid_output")
    some.fit_and_score(features)
    odd = features.filter("day % 2 = 1").groupBy("site").agg({"energy_kwh": "max"}).collect()
    peaks = {r.site: r["max(energy_kwh)"] for r in odd}
    for s in RUN_SITES:
        assert some.models[s.site].capacity == pytest.approx(peaks[s.site] * s.capacity_factor)


def test_without_series(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        SiteForecast(spark, str(tmp_path), RUN_SITES).run()


def test_by_way_of_a_copy(spark, base, run, first, tmp_path):
    copied = SiteForecast(
        spark, str(base[0]), RUN_SITES, results=str("copied"), settings=SETTINGS, mirror=True, csv=False
    )
    series = copied.build_series().toPandas()
    want = run.load_series().toPandas()
    keys = ["site", "time"]
    pd.testing.assert_frame_equal(
        series[want.columns].sort_values(keys, ignore_index=True),
        want.sort_values(keys, ignore_index=True),
    )
    # All dates are copied, so a second run has nothing to do.
    path = copied.refresh_mirror()
    assert spark.read.parquet(path).count() == len(base[1]) * 6


def test_calendar_along_the_line(spark, base, first):
    features = spark.read.parquet(f"{base[0]}/results/mid_output").drop("year")
    some = features.filter("site = 'yangyang' and (hour <> 0 or day <> 4)")
    lines = regular_features(some, RUN_SITES[2:], calendar="interpolate").toPandas()
    at = lines[lines.time == pd.Timestamp("2024-01-04")]
    assert at.hour.tolist() == [12.0]
    assert at.day.tolist() == [3.5]


def test_options_are_checked(spark):
    with pytest.raises(ValueError):
        SiteForecast(spark, "/tmp", capacity_from="moon")
    with pytest.raises(ValueError):
        regular_features(None, RUN_SITES, calendar="lunar")


def test_stream_equals_batch(spark, tmp_path):
    root = tmp_path / "grid"
    mirror, checkpoint = str(tmp_path / "mirror"), str(tmp_path / "checkpoint")
    tree(root, "2024-01-01 00:00", "2024-01-01 05:00")
    schema = spark.read.option("recursiveFileLookup", "true").parquet(str(root)).schema

    def take_in():
        near = near_any_site(RUN_SITES)
        cells = snapshot_stream(spark, str(root), schema, files_per_batch=4, where=near)
        ingest(cells, RUN_SITES, mirror, checkpoint).awaitTermination()
        return ingested(spark, mirror)

    assert take_in().count() == 6 * 6
    tree(root, "2024-01-01 06:00", "2024-01-02 01:00")
    (root / "20240101" / "bad.parquet").write_bytes(b"")
    made = take_in()
    assert made.count() == 26 * 6
    assert made.select("site", "time").distinct().count() == 26 * 3
    assert take_in().count() == 26 * 6


def test_stream_sets_damaged_files_aside(spark, tmp_path):
    """No footer, damaged pages, a name without a time: none stops the others, none is half read."""
    root = tmp_path / "grid"
    places = [str(tmp_path / n) for n in ("mirror", "checkpoint", "quarantine")]
    tree(root, "2024-01-01 00:00", "2024-01-01 05:00")
    (root / "20240101" / "2024-01-01_06_00_00.parquet").write_bytes(b"no parquet")
    pages = root / "20240101" / "2024-01-01_02_00_00.parquet"
    data = bytearray(pages.read_bytes())
    data[4:400] = b"\xff" * 396
    pages.write_bytes(bytes(data))
    (root / "20240101" / "notes.parquet").write_bytes(b"x")

    def take_in():
        ingest_tree(spark, str(root), RUN_SITES, *places, files_per_batch=4).awaitTermination()
        return ingested(spark, places[0])

    assert take_in().count() == 5 * 6
    aside = spark.read.parquet(places[2]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.status) for r in aside) == [
        ("2024-01-01_02_00_00.parquet", "unreadable"),
        ("2024-01-01_06_00_00.parquet", "unreadable"),
        ("notes.parquet", "bad_name"),
    ]
    # A later run takes new files only; a column that is new stays out of the older rows.
    tree(root, "2024-01-01 07:00", "2024-01-01 08:00")
    made = take_in()
    assert made.count() == 7 * 6
    assert made.select("site", "time").distinct().count() == 7 * 3
    assert spark.read.parquet(places[2]).count() == 3
