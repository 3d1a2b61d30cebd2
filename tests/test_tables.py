import datetime as dt

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from windspan.sites import DEFAULT_SITES
from windspan.sources import tables


def put(path, frame, **kw):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.Table.from_pandas(frame, **kw), path)


def test_target_of_many_kinds(spark, tmp_path):
    """Zoned nanosecond times, droppable columns, columns only some files have."""
    zoned = pd.date_range("2024-01-01 00:00", periods=2, freq="h", tz="Asia/Seoul")
    put(
        tmp_path / "wind_gyeongju.parquet",
        pd.DataFrame(
            {
                "end_datetime": zoned.astype("datetime64[us, Asia/Seoul]"),
                "energy_kwh": [1.0, float("nan")],
                "구분": "x",
                "시간": 1,
                "energy_mwh": 0.1,
                "plant_name": "p",
                "period_hours": 1.0,
            }
        ),
    )
    put(
        tmp_path / "wind_yeongduk.parquet",
        pd.DataFrame(
            {
                "end_datetime": zoned.astype("datetime64[us, Asia/Seoul]"),
                "energy_kwh": [3.0, 4.0],
                "quality": [1.0, 2.0],
            }
        ),
    )
    target = tables.read_target(spark, str(tmp_path))
    assert set(target.columns) == {"end_datetime", "energy_kwh", "quality", "filename"}
    local = tables.localise_target(target, DEFAULT_SITES).orderBy("site", "end_datetime")
    assert dict(local.dtypes)["end_datetime"] == "timestamp_ntz"
    rows = local.collect()
    assert [(r.site, r.end_datetime, r.energy_kwh, r.quality, r.date, r.hour) for r in rows] == [
        ("gyeongju", dt.datetime(2024, 1, 1, 0), 1.0, None, dt.date(2024, 1, 1), 0),
        ("gyeongju", dt.datetime(2024, 1, 1, 1), None, None, dt.date(2024, 1, 1), 1),
        ("yeongdeok", dt.datetime(2024, 1, 1, 0), 3.0, 1.0, dt.date(2024, 1, 1), 0),
        ("yeongdeok", dt.datetime(2024, 1, 1, 1), 4.0, 2.0, dt.date(2024, 1, 1), 1),
    ]


def test_target_nanoseconds_and_name_pattern(spark, tmp_path):
    times = pd.date_range("2024-05-01", periods=2, freq="h")
    put(
        tmp_path / "yangyang_target.parquet",
        pd.DataFrame({"end_datetime": times, "energy_kwh": [1.0, 2.0]}),
    )
    assert pq.read_schema(tmp_path / "yangyang_target.parquet").field("end_datetime").type == pa.timestamp("ns")
    target = tables.read_target(spark, str(tmp_path), r"^([a-z]+)_target$")
    rows = tables.localise_target(target, DEFAULT_SITES).orderBy("end_datetime").collect()
    assert [(r.site, r.end_datetime) for r in rows] == [
        ("yangyang", t.to_pydatetime()) for t in times
    ]
    # The default rule takes the last part of the name, which is no site's tag here.
    assert tables.localise_target(tables.read_target(spark, str(tmp_path)), DEFAULT_SITES).count() == 0


def test_missing_target(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no target files"):
        tables.read_target(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError, match="no target files"):
        tables.read_target(spark, str(tmp_path / "empty"))


def series(spark, sites):
    return spark.createDataFrame(
        [(s, dt.datetime(2024, 1, 1, h), float(h)) for s in sites for h in range(3)],
        "site string, time timestamp_ntz, pmsl double",
    )


def test_series_round_trip(spark, tmp_path):
    path = str(tmp_path / "series")
    df = series(spark, [s.site for s in DEFAULT_SITES])
    tables.write_series(df, path, f"{path}_csv")
    back = tables.read_series(spark, path, DEFAULT_SITES)
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    csv = spark.read.option("header", True).schema(df.schema).csv(f"{path}_csv")
    assert sorted(map(tuple, csv.collect())) == sorted(map(tuple, df.collect()))


def test_series_needs_every_site(spark, tmp_path):
    path = str(tmp_path / "series")
    with pytest.raises(FileNotFoundError, match="no series at"):
        tables.read_series(spark, path, DEFAULT_SITES)
    tables.write_series(series(spark, ["gyeongju", "yangyang"]), path)
    with pytest.raises(FileNotFoundError, match="yeongdeok"):
        tables.read_series(spark, path, DEFAULT_SITES)


def test_features_from_pandas_files(spark, tmp_path):
    times = pd.date_range("2024-05-01", periods=3, freq="h")
    for s in DEFAULT_SITES[:2]:
        frame = pd.DataFrame(
            {"time": times, "x": [1.0, None, 3.0], "energy_kwh": 2.0}, index=[5, 7, 9]
        )
        put(tmp_path / f"{s.short}.parquet", frame, preserve_index=True)
    assert "__index_level_0__" in pq.read_schema(tmp_path / "gy.parquet").names
    none, missing = tables.read_features(spark, str(tmp_path), DEFAULT_SITES)
    assert none is None and missing == ["yy"]
    made, missing = tables.read_features(spark, str(tmp_path), DEFAULT_SITES[:2])
    assert missing == []
    assert set(made.columns) == {"time", "x", "energy_kwh", "site"}
    rows = made.filter("site = 'gyeongju'").orderBy("time").collect()
    assert [(r.time, r.x) for r in rows] == list(zip(times.to_pydatetime(), [1.0, None, 3.0]))


def test_forecast_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), 1.5, "경주풍력"), (dt.datetime(2024, 1, 2), 2.5, "양양풍력")],
        "time timestamp_ntz, energy_kwh double, plant_name string",
    )
    path = str(tmp_path / "result.csv")
    tables.write_forecast(df, path)
    assert sorted(map(tuple, tables.read_forecast(spark, path).collect())) == sorted(map(tuple, df.collect()))


NANOS = "spark.sql.legacy.parquet.nanosAsLong"


def test_nanosecond_columns_leave_no_trace(spark, tmp_path):
    """Target and features with nanosecond times, next to files without; the setting is as before."""
    times = pd.date_range("1969-12-31 23:59:59.999999500", periods=3, freq="h")
    put(
        tmp_path / "target" / "wind_yangyang.parquet",
        pd.DataFrame({"end_datetime": times, "energy_kwh": 1.0, "stamp": times.tz_localize("Asia/Seoul")}),
    )
    put(
        tmp_path / "target" / "wind_gyeongju.parquet",
        pd.DataFrame({"end_datetime": times.astype("datetime64[us]"), "energy_kwh": 2.0}),
    )
    before = spark.conf.get(NANOS)
    target = tables.read_target(spark, str(tmp_path / "target"))
    assert spark.conf.get(NANOS) == before
    assert dict(target.dtypes)["stamp"] == "timestamp"
    rows = target.filter("filename = 'yangyang'").orderBy("end_datetime").collect()
    assert [r.end_datetime for r in rows] == list(times.floor("us").to_pydatetime())
    assert target.count() == 6

    cells = tmp_path / "features"
    for s in DEFAULT_SITES:
        put(cells / f"{s.short}.parquet", pd.DataFrame({"time": times, "stamp": times, "x": 1.0}))
    made, _ = tables.read_features(spark, str(cells), DEFAULT_SITES)
    assert spark.conf.get(NANOS) == before
    assert dict(made.dtypes)["time"] == dict(made.dtypes)["stamp"] == "timestamp_ntz"


def test_series_files(spark, tmp_path):
    """One file a site as other tools write them, in one scan; a missing site is named."""
    for s in DEFAULT_SITES[:2]:
        times = pd.date_range("2024-05-01", periods=3, freq="h")
        put(
            tmp_path / f"{s.label}_test" / f"{s.label}_timeseries_MAX.parquet",
            pd.DataFrame({"time": times, "pmsl": [1.0, float("nan"), 3.0], s.short: 1.0}),
            preserve_index=False,
        )
    put(tmp_path / "x_test" / "x_timeseries_MAX.parquet", pd.DataFrame({"time": ["no time"]}))
    with pytest.raises(FileNotFoundError, match=DEFAULT_SITES[2].site):
        tables.read_series_files(spark, str(tmp_path), DEFAULT_SITES)
    with pytest.raises(FileNotFoundError, match="gyeongju"):
        tables.read_series_files(spark, str(tmp_path / "none"), DEFAULT_SITES)
    made = tables.read_series_files(spark, str(tmp_path), DEFAULT_SITES[:2])
    assert set(made.columns) == {"site", "time", "pmsl", "gy", "yd"}
    assert dict(made.dtypes)["time"] == "timestamp_ntz"
    counts = {r.site: (r.n, r.p) for r in made.groupBy("site").agg(
        F.count("*").alias("n"), F.count("pmsl").alias("p")).collect()}
    assert counts == {"gyeongju": (3, 2), "yeongdeok": (3, 2)}
    last = made.filter("site = 'gyeongju'").orderBy("time").collect()[-1]
    assert (last.time, last.pmsl, last.yd) == (dt.datetime(2024, 5, 1, 2), 3.0, None)


def test_all_target_rows_are_kept(spark, tmp_path):
    zoned = pd.date_range("2024-01-01", periods=2, freq="h", tz="Asia/Seoul").astype("datetime64[us, Asia/Seoul]")
    for tag in ("gyeongju", "elsewhere"):
        put(tmp_path / f"wind_{tag}.parquet", pd.DataFrame({"end_datetime": zoned, "energy_kwh": 1.0}))
    target = tables.read_target(spark, str(tmp_path), sites=DEFAULT_SITES)
    rows = tables.localise_target(target, DEFAULT_SITES, keep_unknown=True).collect()
    assert sorted((r.filename, r.site, r.hour) for r in rows) == [
        ("elsewhere", None, 0), ("elsewhere", None, 1), ("gyeongju", "gyeongju", 0), ("gyeongju", "gyeongju", 1)
    ]
    assert tables.localise_target(target, DEFAULT_SITES).count() == 2
