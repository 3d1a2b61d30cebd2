"""Resumed runs: which tables are taken and which are made again."""

import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from trees import hour_cells, put, tree

from windspan.plans.forecast import SiteForecast
from windspan.plans.stages import StageLog, listing_mark, mark
from windspan.plans.table_views import SITES
from windspan.sources.snapshots import list_snapshots

RUN_SITES = tuple(
    dataclasses.replace(
        s, end_date="2024-01-02", spine_end="2024-01-02 23:00:00" if s.gaps == "interpolate" else None
    )
    for s in SITES
)


@pytest.fixture
def run(spark, tmp_path):
    tree(tmp_path / "ldaps", "2024-01-01 00:00", "2024-01-02 22:00")
    at = pd.date_range("2024-01-01", "2024-01-02 23:00", freq="h")
    for s in RUN_SITES:
        target = pd.DataFrame({"end_datetime": at, "energy_kwh": np.arange(len(at)) * 1.0})
        put_target(tmp_path, s.target_tag, target)
    return SiteForecast(spark, str(tmp_path), RUN_SITES, csv=False)


def put_target(root, tag, frame):
    path = root / "target" / f"wind_{tag}.parquet"
    path.parent.mkdir(exist_ok=True)
    frame = frame.astype({"end_datetime": "datetime64[us]"})
    pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), path)


def rows(df):
    return sorted(map(str, df.select("site", "time", "pmsl", "energy_kwh").collect()))


def test_every_starting_point(run, tmp_path):
    assert run.latest_stage() == "grid"
    first = rows(run.resume_features())
    assert run.latest_stage() == "features"
    assert rows(run.resume_features()) == first

    # The features were being written anew when the run ended.
    run.stages.begin("features", "whatever")
    assert run.latest_stage() == "series"
    assert rows(run.resume_features()) == first

    # So were the series.
    run.stages.begin("features", "whatever")
    run.stages.begin("series", "whatever")
    assert run.latest_stage() == "grid"
    assert rows(run.resume_features()) == first

    # One more hour: what was made before it is out of date.
    put(tmp_path / "ldaps", pd.Timestamp("2024-01-02 23:00"), hour_cells(pd.Timestamp("2024-01-02 23:00")))
    assert run.latest_stage() == "grid"
    more = rows(run.resume_features())
    assert len(more) > 0 and more != first

    # Other measured output: the series still hold.
    put_target(tmp_path, RUN_SITES[0].target_tag, pd.DataFrame({"end_datetime": [pd.Timestamp("2024-01-01 05:00")], "energy_kwh": [1.0]}))
    assert run.latest_stage() == "series"

    # Other sites' settings: nothing does.
    other = SiteForecast(run.spark, str(tmp_path), RUN_SITES[:2], csv=False)
    assert other.latest_stage() == "grid"


def test_a_stage_without_a_row_is_made(run, spark, tmp_path):
    run.build_features(run.build_series(), run.load_target())  # by hand: no row for the features
    assert run.latest_stage() == "series"


def test_series_from_elsewhere(run, spark, tmp_path):
    series = run.build_series()
    made = rows(run.resume_features())
    alone = tmp_path / "alone"
    (alone / "results").mkdir(parents=True)
    for s in RUN_SITES:
        one = series.filter(series.site == s.site).drop("site").toPandas()
        one["time"] = one["time"].astype("datetime64[ns]")
        path = alone / "results" / f"{s.label}_test" / f"{s.label}_timeseries_MAX.parquet"
        path.parent.mkdir()
        pq.write_table(pa.Table.from_pandas(one, preserve_index=False), path)
    (alone / "target").symlink_to(tmp_path / "target")
    given = SiteForecast(spark, str(alone), RUN_SITES, csv=False)
    assert given.latest_stage() == "series"
    assert rows(given.resume_features()) == made
    assert given.latest_stage() == "features"


def test_log(spark, tmp_path):
    log = StageLog(spark, str(tmp_path / "log"))
    assert not log.finished("a", "x")
    first = log.begin("a", "x")
    assert not log.finished("a", "x")
    log.finish("a", "x", first)
    assert log.finished("a", "x") and not log.finished("a", "y") and not log.finished("b", "x")


def test_marks(spark, tmp_path):
    root = tmp_path / "grid"
    tree(root, "2024-01-01 00:00", "2024-01-01 02:00")
    before = listing_mark(list_snapshots(spark, str(root)), str(root))
    assert before == listing_mark(list_snapshots(spark, str(root)).repartition(3), str(root))
    put(root, pd.Timestamp("2024-01-01 01:00"), hour_cells(pd.Timestamp("2024-01-01 01:00"), 3))
    assert before != listing_mark(list_snapshots(spark, str(root)), str(root))
    assert mark(1, "a") != mark(1, "b")
