"""The copy that follows a snapshot tree file by file."""

import dataclasses
import shutil

import pandas as pd
import pytest
from trees import hour_cells, put, tree

from windspan.plans.forecast import SiteForecast
from windspan.plans.table_views import SITES
from windspan.sources import mirror
from windspan.sources.snapshots import list_snapshots

DAY = "2024-01-01"


def stamp(hour, day=DAY):
    return pd.Timestamp(f"{day} {hour:02}:00")


def refresh(spark, root, path, sites=SITES):
    return mirror.refresh(spark, str(root), sites, str(path))


def cells(spark, path):
    return mirror.read_copied(spark, str(path)).toPandas()


def per_hour(made):
    return made.groupby(["site", "time"]).size()


def test_a_late_hour_of_a_copied_date(spark, tmp_path):
    root, path = tmp_path / "grid", tmp_path / "mirror"
    tree(root, f"{DAY} 00:00", f"{DAY} 02:00")
    assert refresh(spark, root, path) == 3 * len(SITES)
    put(root, stamp(3), hour_cells(stamp(3)))
    assert refresh(spark, root, path) == len(SITES)
    made = cells(spark, path)
    assert per_hour(made).eq(2).all() and len(per_hour(made)) == 4 * len(SITES)
    assert set(made.date) == {"20240101"}
    late = made[made.time == stamp(3)].pmsl
    assert set(late.round(6)) <= set(hour_cells(stamp(3)).pmsl.round(6))


def test_nothing_new_opens_no_file(spark, tmp_path):
    root, path = tmp_path / "grid", tmp_path / "mirror"
    hours = tree(root, f"{DAY} 00:00", f"{DAY} 03:00")
    refresh(spark, root, path)
    before = cells(spark, path)
    for at in hours:  # as long as before, but no Parquet: reading any would fail or drop it
        file = root / f"{at:%Y%m%d}" / f"{at:%Y-%m-%d_%H_%M_%S}.parquet"
        file.write_bytes(b"x" * file.stat().st_size)
    assert refresh(spark, root, path) == 0
    keys = ["site", "time", "latitude"]
    pd.testing.assert_frame_equal(
        cells(spark, path).sort_values(keys, ignore_index=True),
        before.sort_values(keys, ignore_index=True),
    )


def test_copied_hours_outlive_their_files(spark, tmp_path):
    """A late hour does not take the others of its date along when their files are gone."""
    root, path = tmp_path / "grid", tmp_path / "mirror"
    tree(root, f"{DAY} 00:00", f"{DAY} 02:00")
    refresh(spark, root, path)
    shutil.rmtree(root / "20240101")
    put(root, stamp(5), hour_cells(stamp(5)))
    refresh(spark, root, path)
    assert len(per_hour(cells(spark, path))) == 4 * len(SITES)


def test_a_file_written_anew_replaces_its_cells(spark, tmp_path):
    root, path = tmp_path / "grid", tmp_path / "mirror"
    tree(root, f"{DAY} 00:00", f"{DAY} 01:00")
    refresh(spark, root, path)
    put(root, stamp(1), hour_cells(stamp(1), per_site=5))
    assert refresh(spark, root, path) == len(SITES)
    counts = per_hour(cells(spark, path)).unstack()
    assert counts[stamp(0)].eq(2).all() and counts[stamp(1)].eq(5).all()


def test_a_batch_without_its_ledger_rows_does_not_count(spark, tmp_path):
    root, path = tmp_path / "grid", tmp_path / "mirror"
    tree(root, f"{DAY} 00:00", f"{DAY} 01:00")
    refresh(spark, root, path)
    put(root, stamp(2), hour_cells(stamp(2)))
    refresh(spark, root, path)
    # As if the second refresh had been cut off after its cells.
    ledger = mirror.copied_files(spark, str(path)).toPandas()
    first = ledger[ledger.time < stamp(2)]
    shutil.rmtree(f"{path}_files")
    spark.createDataFrame(first, mirror.LEDGER).write.parquet(f"{path}_files")
    assert len(per_hour(cells(spark, path))) == 2 * len(SITES)
    assert refresh(spark, root, path) == len(SITES)
    assert per_hour(cells(spark, path)).eq(2).all()


def test_empty_boxes_and_damaged_files(spark, tmp_path):
    root, path = tmp_path / "grid", tmp_path / "mirror"
    tree(root, f"{DAY} 00:00", f"{DAY} 00:00")
    put(root, stamp(1), hour_cells(stamp(1)).tail(1))  # no cell near a site
    bad = root / "20240101" / "2024-01-01_02_00_00.parquet"
    bad.write_bytes(b"no parquet here")
    assert refresh(spark, root, path) == 2 * len(SITES)
    assert {r.time for r in mirror.copied_hours(spark, str(path)).collect()} == {stamp(0), stamp(1)}
    assert refresh(spark, root, path) == 0  # only the damaged file is looked at again
    put(root, stamp(2), hour_cells(stamp(2)))
    assert refresh(spark, root, path) == len(SITES)


def test_a_site_that_joins_and_dates_of_sites(spark, tmp_path):
    root, path = tmp_path / "grid", tmp_path / "mirror"
    tree(root, "2024-01-01 22:00", "2024-01-02 01:00")
    short = dataclasses.replace(SITES[1], start_date="2024-01-02")
    assert refresh(spark, root, path, SITES[:1]) == 4
    assert refresh(spark, root, path, (SITES[0], short)) == 2
    counts = per_hour(cells(spark, path))
    assert counts.groupby("site").size().to_dict() == {SITES[0].site: 4, short.site: 2}


def test_pending_needs_names_only(spark, tmp_path):
    root = tmp_path / "grid"
    tree(root, f"{DAY} 00:00", f"{DAY} 01:00")
    none = mirror.copied_files(spark, str(tmp_path / "none"))
    todo = mirror.pending_files(list_snapshots(spark, str(root)), none, SITES, str(root))
    assert todo.count() == 2 * len(SITES)
    assert {r.file for r in todo.collect()} == {
        f"/20240101/2024-01-01_0{h}_00_00.parquet" for h in range(2)
    }


def test_late_hours_reach_the_series(spark, tmp_path):
    sites = tuple(dataclasses.replace(s, end_date=DAY) for s in SITES)
    run = SiteForecast(spark, str(tmp_path), sites, mirror=True, csv=False)
    tree(tmp_path / "ldaps", f"{DAY} 00:00", f"{DAY} 02:00")
    assert run.build_series().count() == 3 * len(sites)
    put(tmp_path / "ldaps", stamp(3), hour_cells(stamp(3)))
    made = run.build_series()
    assert made.count() == 4 * len(sites) and made.filter("pmsl is null").isEmpty()


def test_no_cells_at_all(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        mirror.read_copied(spark, str(tmp_path / "none"))
