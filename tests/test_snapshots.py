import pandas as pd
import pytest
from pyspark.sql import functions as F
from trees import hour_cells, put, site_maxima, tree

from windspan.operators.aggregates import restore_hours, site_hours, site_series
from windspan.operators.joins import cells_of_sites
from windspan.operators.selection import near_any_site
from windspan.plans.table_views import SITES
from windspan.sources import snapshots


def stamp(text):
    return pd.Timestamp(text)


@pytest.fixture
def edge_tree(tmp_path):
    """Two good hours among everything that can be wrong with a file."""
    root = tmp_path / "grid"
    good = [stamp("2024-01-02 03:00"), stamp("2024-01-03 04:00")]
    for at in good:
        put(root, at, hour_cells(at))
    put(root, stamp("2024-01-02 05:00"), hour_cells(good[0]), folder="20240103")
    put(root, stamp("2024-01-02 06:00"), hour_cells(good[0]), folder="notes")
    bad = root / "20240102" / "not-a-time.parquet"
    bad.write_bytes((root / "20240102" / "2024-01-02_03_00_00.parquet").read_bytes())
    (root / "20240102" / "2024-01-02_07_00_00.parquet").write_bytes(b"no parquet here")
    (root / "20240102" / "readme.txt").write_text("hello")
    empty = stamp("2024-01-02 08:00")
    put(root, empty, hour_cells(empty).tail(1))
    rowless = stamp("2024-01-02 09:00")
    put(root, rowless, hour_cells(rowless).head(0))
    extra = stamp("2024-01-02 10:00")
    put(root, extra, hour_cells(extra).assign(gust=1.5, note="x"))
    return str(root), good, [empty, rowless], extra


def test_listing(spark, edge_tree):
    root, *_ = edge_tree
    rows = snapshots.list_snapshots(spark, root).collect()
    by_status = {}
    for r in rows:
        by_status.setdefault(r.status, []).append(r.stem)
    assert sorted(by_status["ok"]) == [
        "2024-01-02_03_00_00",
        "2024-01-02_07_00_00",
        "2024-01-02_08_00_00",
        "2024-01-02_09_00_00",
        "2024-01-02_10_00_00",
        "2024-01-03_04_00_00",
    ]
    assert by_status["bad_name"] == ["not-a-time"]
    assert by_status["wrong_folder"] == ["2024-01-02_05_00_00"]
    assert snapshots.rejected_snapshots(spark, root).count() == 2
    assert [r.date for r in snapshots.folder_dates(spark, root).collect()] == ["20240102", "20240103"]
    only = snapshots.list_snapshots(spark, root, start="2024-01-03", end="2024-01-03")
    assert {r.folder_date for r in only.collect()} == {"20240103"}


def test_scan_and_series(spark, edge_tree):
    root, good, empty, extra = edge_tree
    cells = snapshots.scan_snapshots(spark, root)
    assert {"gust", "note", "level"} <= set(cells.columns)
    hours = snapshots.expected_hours(snapshots.list_snapshots(spark, root))
    series = restore_hours(site_series(cells_of_sites(cells, SITES)), site_hours(hours, SITES))
    assert "note" not in series.columns
    made = series.toPandas()
    # One row per readable file and site; unreadable bytes give none.
    assert sorted(made.time.unique()) == sorted([*good, *empty, extra])
    assert len(made) == 5 * len(SITES)
    assert made[made.time.isin(empty)].pmsl.isna().all()
    assert made[made.time == extra].gust.eq(1.5).all()
    want = site_maxima(good).sort_values(["site", "time"], ignore_index=True)
    got = made[made.time.isin(good)].sort_values(["site", "time"], ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_without_the_guard(spark, edge_tree):
    root, *_ = edge_tree
    guarded = snapshots.scan_snapshots(spark, root)
    free = snapshots.scan_snapshots(spark, root, same_date=False)
    assert free.count() == guarded.count() + 7


def test_unreadable_file_can_fail(spark, edge_tree):
    root, *_ = edge_tree
    schema = snapshots.scan_snapshots(spark, root).drop("time").schema
    with pytest.raises(Exception, match="(?i)parquet"):
        snapshots.scan_snapshots(spark, root, schema, skip_unreadable=False).collect()


def test_dates_prune_files(spark, tmp_path):
    tree(tmp_path, "2024-01-01 00:00", "2024-01-03 23:00")
    df = snapshots.scan_snapshots(spark, str(tmp_path), start="2024-01-02", end="2024-01-02")
    assert len(df.collect()) == 24 * 7
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().apply("numFiles").value() == 24


def test_cells_are_tested_before_paths(spark, tmp_path):
    tree(tmp_path, "2024-01-01 00:00", "2024-01-01 03:00")
    df = snapshots.scan_snapshots(spark, str(tmp_path), where=near_any_site(SITES))
    assert df.count() == 4 * 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Paths are settled before the scan; the time is taken from them for cells near a site only.
    assert not any("Filter" in line and "regexp" in line for line in plan.splitlines())
    assert plan.index("regexp_extract") < plan.index("Filter")
    assert "latitude" in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def test_schema_profile(spark, edge_tree, monkeypatch):
    root, *_ = edge_tree
    footers = snapshots.snapshot_footers(snapshots.list_snapshots(spark, root)).cache()
    assert footers.filter("not readable").count() == 1
    rows = snapshots.schema_profile(footers).orderBy("n_files").collect()
    assert [r.n_files for r in rows] == [1, 6]
    assert "gust: double, note: string" in rows[0].signature
    assert rows[0].paths[0].endswith("2024-01-02_10_00_00.parquet")
    assert rows[1].paths is None
    plan = snapshots.schema_profile(footers)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_mirror_replaces_only_its_dates(spark, tmp_path):
    root, copy = tmp_path / "grid", str(tmp_path / "copy")
    tree(root, "2024-01-01 00:00", "2024-01-02 23:00")
    cells = snapshots.scan_snapshots(spark, str(root))
    snapshots.write_mirror(cells, SITES, copy)
    whole = snapshots.read_mirror(spark, copy).count()
    assert whole == 48 * 6
    snapshots.write_mirror(cells.filter("day(time) = 2"), SITES, copy)
    back = snapshots.read_mirror(spark, copy)
    assert back.count() == whole
    assert dict(back.dtypes)["date"] == "string"
    done = {tuple(r) for r in snapshots.done_dates(spark, copy).collect()}
    assert done == {(s.site, d) for s in SITES for d in ("20240101", "20240102")}


def test_base_below_a_folder_of_digits(spark, tmp_path):
    root = tmp_path / "20231231" / "ldaps"
    tree(root, "2024-01-01 00:00", "2024-01-01 02:00")
    (root / "notes").mkdir()
    put(root, stamp("2024-01-01 03:00"), hour_cells(stamp("2024-01-01 03:00")), folder="notes")
    for name in (str(root), f"file:{root}", f"file://{root}/"):
        listed = snapshots.list_snapshots(spark, name).collect()
        assert [r.folder_date for r in listed] == ["20240101"] * 3
        assert {r.status for r in listed} == {"ok"}
        assert snapshots.scan_snapshots(spark, name).count() == 3 * 7


def test_hours_that_a_zone_skips(spark, tmp_path):
    root, zone = tmp_path / "grid", spark.conf.get("spark.sql.session.timeZone")
    hours = tree(root, "2024-03-10 00:00", "2024-03-10 04:00")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        cells = snapshots.scan_snapshots(spark, str(root)).select("time").distinct().collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(r.time for r in cells) == [h.to_pydatetime() for h in hours]


def test_damaged_page_fails(spark, tmp_path):
    at = stamp("2024-01-01 00:00")
    cells = pd.concat([hour_cells(at)] * 2000, ignore_index=True)
    path = put(tmp_path, at, cells)
    data = bytearray(path.read_bytes())
    data[200:4000] = bytes(3800)
    path.write_bytes(bytes(data))
    with pytest.raises(Exception):
        snapshots.scan_snapshots(spark, str(tmp_path)).agg({"pmsl": "max", "latitude": "max"}).collect()


def test_file_that_cannot_be_opened_fails(spark, tmp_path):
    tree(tmp_path, "2024-01-01 00:00", "2024-01-01 02:00")
    listed = snapshots.list_snapshots(spark, str(tmp_path))
    odd = listed.withColumn("path", F.regexp_replace("path", "^file:", "unknownfs://x"))
    with pytest.raises(Exception):
        snapshots.expected_hours(odd).collect()


def test_rejects_name_unreadable_files(spark, edge_tree):
    root, *_ = edge_tree
    found = {r.path.rsplit("/", 1)[1]: r.status for r in snapshots.rejected_snapshots(spark, root, True).collect()}
    assert found == {
        "not-a-time.parquet": "bad_name",
        "2024-01-02_05_00_00.parquet": "wrong_folder",
        "2024-01-02_07_00_00.parquet": "unreadable",
    }


def test_hours_of_the_series_stay(spark):
    series = spark.sql("select 'a' as site, timestamp_ntz'2024-01-01 00:00:00' as time, 1.0D as x")
    expected = spark.sql("select 'a' as site, timestamp_ntz'2024-01-01 01:00:00' as time")
    assert {r.x for r in restore_hours(series, expected).collect()} == {1.0, None}


def test_one_look_at_each_file(spark, edge_tree):
    """Schema, hours, rejects, profile and scan from one catalogue: the rest of the tree may go."""
    root, good, empty, extra = edge_tree
    catalogue = snapshots.read_catalogue(spark, root, "2024-01-02", "2024-01-02")
    assert catalogue.select("folder_date").distinct().collect() == [("20240102",)]
    assert snapshots.united_schema(catalogue).fieldNames()[-2:] == ["gust", "note"]
    statuses = {r.path.rsplit("/", 1)[1]: r.status for r in snapshots.rejects(catalogue).collect()}
    assert statuses == {"not-a-time.parquet": "bad_name", "2024-01-02_07_00_00.parquet": "unreadable"}
    assert snapshots.expected_hours(catalogue).count() == 4
    profile = snapshots.schema_profile(catalogue).collect()
    assert sorted(r.n_files for r in profile) == [1, 3]
    cells = snapshots.scan_snapshots(spark, root, catalogue=catalogue, file="file")
    read = {r.file for r in cells.select("file").distinct().collect()}
    assert read == {f"/20240102/2024-01-02_{h:02}_00_00.parquet" for h in (3, 8, 10)}
    assert len(cells.inputFiles()) == 4  # one file holds no rows


def test_a_file_outside_the_dates_does_not_matter(spark, tmp_path):
    root = tmp_path / "grid"
    at = stamp("2024-01-02 03:00")
    put(root, at, hour_cells(at))
    other = stamp("2024-01-05 03:00")
    put(root, other, hour_cells(other).assign(pmsl="text", wide=1))
    cells = snapshots.scan_snapshots(spark, str(root), start="2024-01-01", end="2024-01-03")
    assert "wide" not in cells.columns and dict(cells.dtypes)["pmsl"] == "double"
    with pytest.raises(ValueError, match="pmsl: double, string"):
        snapshots.scan_snapshots(spark, str(root))


def test_names_with_special_characters(spark, tmp_path):
    root = tmp_path / "gr id+[1]" / "하나{a,b}"
    at = stamp("2024-01-02 03:00")
    put(root, at, hour_cells(at))
    cells = snapshots.scan_snapshots(spark, str(root), file="file")
    assert {r.file for r in cells.collect()} == {"/20240102/2024-01-02_03_00_00.parquet"}


def test_kinds_of_columns(spark, tmp_path):
    root = tmp_path / "grid"
    at = stamp("2024-01-02 03:00")
    cells = hour_cells(at).assign(
        small=pd.Series(range(7), dtype="uint32"),
        kind=pd.Categorical(["x"] * 7),
        nanos=pd.Timestamp("2024-01-01 00:00:00.000000001"),
        micros=pd.Series([stamp("2024-01-01")] * 7, dtype="datetime64[us]"),
    )
    put(root, at, cells)
    made = snapshots.scan_snapshots(spark, str(root))
    kinds = dict(made.dtypes)
    assert kinds["small"] == "bigint" and kinds["kind"] == "string" and kinds["micros"] == "timestamp_ntz"
    assert "nanos" not in kinds
    assert made.filter("small = 6 and kind = 'x'").count() == 1


def test_whole_files(spark, edge_tree):
    root, *_ = edge_tree
    path = f"{root}/20240102/2024-01-02_03_00_00.parquet"
    data = bytearray(open(path, "rb").read())
    data[4:400] = b"\xff" * 396  # pages, not the footer
    open(path, "wb").write(bytes(data))
    found = snapshots.whole_files(snapshots.read_catalogue(spark, root)).collect()
    assert {r.stem: (r.readable, r.whole) for r in found if r.status == "ok"} == {
        "2024-01-02_03_00_00": (True, False),
        "2024-01-02_07_00_00": (False, False),
        "2024-01-02_08_00_00": (True, True),
        "2024-01-02_09_00_00": (True, True),
        "2024-01-02_10_00_00": (True, True),
        "2024-01-03_04_00_00": (True, True),
    }
