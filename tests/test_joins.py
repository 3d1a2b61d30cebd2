import dataclasses
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from windspan import sites as site_module
from windspan.operators import aggregates, joins, selection, unions
from windspan.sites import DEFAULT_SITES, Site, check_sites, site_named, sites_frame


def made_site(i, lat, lon, lat_range, lon_range):
    base = DEFAULT_SITES[0]
    return dataclasses.replace(
        base,
        site=f"s{i:03d}",
        target_tag=f"t{i}",
        lat=lat,
        lon=lon,
        lat_range=lat_range,
        lon_range=lon_range,
    )


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame(
        {
            "cell": np.arange(n),
            "latitude": rng.uniform(-4, 4, n).round(1),
            "longitude": rng.uniform(-4, 4, n).round(1),
        }
    )
    # A third of all rows in one spot, and some that are nowhere.
    pdf.loc[:1000, ["latitude", "longitude"]] = 0.5
    pdf.loc[1001:1005, "latitude"] = np.nan
    pdf.loc[1006:1010, "longitude"] = None
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("count", [1, 3, 90])
@pytest.mark.parametrize("limit", [100_000, 0])
def test_cells_of_sites_is_the_range_join(spark, cells, monkeypatch, count, limit):
    monkeypatch.setattr(site_module, "BROADCAST_ROWS", limit)
    rng = np.random.default_rng(count)
    sites = [
        made_site(i, *rng.uniform(-3, 3, 2).round(1), *rng.uniform(0, 1.5, 2).round(1))
        for i in range(count)
    ]
    pdf, df = cells
    got = {(r.site, r.cell) for r in joins.cells_of_sites(df, sites).select("site", "cell").collect()}
    want = set()
    for s in sites:
        south, north, west, east = s.box
        inside = pdf.latitude.between(south, north) & pdf.longitude.between(west, east)
        want |= {(s.site, c) for c in pdf.cell[inside]}
    assert got == want
    assert joins.cells_of_sites(df, sites).count() == len(want)


def test_tiles_stay_few():
    small = [made_site(i, 0.0, i * 0.1, 0.01, 0.01) for i in range(100)]
    assert joins._tile_step(small) == 0.02
    mixed = [*small, made_site(100, 0.0, 0.0, 60.0, 60.0)]
    step = joins._tile_step(mixed)
    assert joins._tile_count(mixed, step) <= joins.MAX_TILES
    assert step < 2


@pytest.mark.parametrize("n", [1, 64, 65, 5000])
def test_filter_of_spread_out_sites_prunes(n):
    boxes = [made_site(i, (i * 37) % 80, (i * 61) % 179, 0.01, 0.01).box for i in range(n)]
    merged = selection.merged_boxes(boxes)
    assert len(merged) == min(n, selection.BOX_TERMS)
    for b in boxes:
        assert any(m[0] <= b[0] and b[1] <= m[1] and m[2] <= b[2] and b[3] <= m[3] for m in merged)
    area = sum((m[1] - m[0]) * (m[3] - m[2]) for m in merged)
    assert area <= 80 * 179


def test_merged_boxes_follow_clusters():
    boxes = [made_site(i, 10.0 * (i % 50), i // 50 * 0.1, 0.01, 0.01).box for i in range(500)]
    area = sum((m[1] - m[0]) * (m[3] - m[2]) for m in selection.merged_boxes(boxes))
    assert area < 0.02 * 490 * 0.92


def test_box_edges_are_inside(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (0.5, 2.5), (0.49, 2.0)], "latitude double, longitude double"
    )
    assert df.filter(selection.in_box((0.5, 1.0, 2.0, 2.5))).count() == 2


def test_empty_box(spark, cells):
    assert joins.cells_of_sites(cells[1], [made_site(0, 50.0, 50.0, 0.1, 0.1)]).count() == 0


def test_box_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "grid")
    spark.createDataFrame([(1.0, 2.0, 3.0)], "latitude double, longitude double, x double").write.parquet(path)
    plan = joins.cells_of_sites(spark.read.parquet(path), DEFAULT_SITES)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert "latitude" in pushed.split("ReadSchema")[0]
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_unknown_tag_and_site(spark):
    df = spark.createDataFrame([("yeongduk", 1), ("atlantis", 2)], "filename string, x int")
    with pytest.raises(PySparkException, match="unknown site tag: atlantis"):
        joins.site_of_tag(df, DEFAULT_SITES).collect()
    known = joins.site_of_tag(df, DEFAULT_SITES, strict=False).collect()
    assert [(r.site, r.x) for r in known] == [("yeongdeok", 1)]
    named = spark.createDataFrame([("gyeongju",), ("nowhere",)], "site string")
    with pytest.raises(PySparkException, match="unknown site: nowhere"):
        joins.with_site_columns(named, DEFAULT_SITES, ["turbine_rad"]).collect()
    with pytest.raises(ValueError, match="unknown site"):
        site_named(DEFAULT_SITES, "nowhere")


def test_site_list_is_checked():
    with pytest.raises(ValueError, match="duplicate site"):
        check_sites([DEFAULT_SITES[0]] * 2)
    with pytest.raises(ValueError, match="no sites"):
        check_sites([])
    with pytest.raises(ValueError, match="spine_start"):
        check_sites([dataclasses.replace(DEFAULT_SITES[0], gaps="interpolate")])


def test_sites_frame(spark):
    rows = {r.site: r for r in sites_frame(spark).collect()}
    assert rows["yeongdeok"].target_tag == "yeongduk"
    assert rows["gyeongju"].start_date == dt.date(2020, 1, 1)
    assert rows["yangyang"].lat_min == 37.9330943 - 0.02


def test_target_join_multiplies_and_matches_missing_times(spark):
    at = dt.datetime(2024, 1, 1)
    series = spark.createDataFrame(
        [("a", at, 1.0), ("a", None, 2.0), ("b", at, 3.0)], "site string, time timestamp_ntz, x double"
    )
    target = spark.createDataFrame(
        [("a", at, 10.0), ("a", at, 11.0), ("a", None, 12.0)],
        "site string, end_datetime timestamp_ntz, energy_kwh double",
    )
    rows = joins.join_target(series, target).orderBy("x", "energy_kwh").collect()
    assert [(r.x, r.energy_kwh) for r in rows] == [(1.0, 10.0), (1.0, 11.0), (2.0, 12.0), (3.0, None)]
    with pytest.raises(ValueError, match="both sides"):
        joins.join_target(series, target.withColumn("x", F.lit(1)))


@pytest.mark.parametrize("bound, limit", [(None, 100_000), (None, 0), (10, 100_000)])
def test_attach_per_key(spark, monkeypatch, bound, limit):
    monkeypatch.setattr(site_module, "BROADCAST_ROWS", limit)
    df = spark.range(1000).selectExpr(
        "if(id % 3 = 0, null, concat('k', id % 2)) as site", "id as time"
    )
    per_key = spark.createDataFrame([("k0", 1), ("k1", 2), (None, 3)], "site string, v int")
    rows = joins.attach_per_key(df, per_key, ["site"], max_rows=bound).collect()
    assert len(rows) == 1000
    assert all(r.v == {"k0": 1, "k1": 2, None: 3}[r.site] for r in rows)


def test_pending_dates_in_order(spark):
    dates = spark.createDataFrame([("a", "2"), ("b", "1"), ("a", "1")], "site string, date string")
    done = spark.createDataFrame([("b", "1")], "site string, date string")
    assert [tuple(r) for r in joins.pending_dates(dates, done).collect()] == [("a", "1"), ("a", "2")]


def test_series_ignores_nan_and_drops_other_types(spark):
    df = spark.createDataFrame(
        [("a", 1, float("nan"), 1, 5, "x"), ("a", 1, 2.0, 7, 6, "y"), ("b", 1, float("nan"), 3, 1, "z")],
        "site string, time int, v double, k long, small int, text string",
    )
    made = aggregates.site_series(df)
    assert made.dtypes == [("site", "string"), ("time", "int"), ("v", "float"), ("k", "bigint")]
    assert sorted(tuple(r) for r in made.collect()) == [("a", 1, 2.0, 7), ("b", 1, None, 3)]


def test_site_hours_respect_dates(spark):
    hours = spark.sql(
        "select explode(sequence(timestamp_ntz '2024-03-31 22:00:00',"
        " timestamp_ntz '2024-04-01 01:00:00', interval 1 hour)) as time"
    )
    counts = aggregates.site_hours(hours, DEFAULT_SITES).groupBy("site").count().collect()
    assert {r.site: r["count"] for r in counts} == {"gyeongju": 4, "yeongdeok": 2, "yangyang": 2}


def test_exclusion_keeps_rows_without_a_time(spark):
    at = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame(
        [("gyeongju", at), ("gyeongju", None), (None, at), ("yangyang", at)],
        "site string, time timestamp_ntz",
    )
    assert selection.exclude_times(df, {"gyeongju": "2020-01-01 00:00:00"}).count() == 3


def test_concat(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2, 1.0)], "i int, d double")
    with pytest.raises(ValueError, match="schemas differ"):
        unions.concat_strict([a, b])
    assert unions.concat_strict([a, a]).count() == 2
    filled = unions.concat_fill([a, b]).orderBy("i").collect()
    assert [tuple(r) for r in filled] == [(1, "x", None), (2, None, 1.0)]


def test_plant_counts(spark):
    df = spark.createDataFrame([("p",), ("p",), ("q",), (None,)], "plant_name string")
    rows = {r.plant_name: r.n_forecasts for r in aggregates.plant_counts(df).collect()}
    assert rows == {"p": 2, "q": 1, None: 1, "(total)": 4}


def test_site_type():
    assert isinstance(DEFAULT_SITES[0], Site)
