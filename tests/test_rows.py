import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from windspan.operators.gaps import interpolate, on_spine, spine, spine_bounds
from windspan.operators.rows import contiguous_folds, moving_average, with_positions
from windspan.sites import DEFAULT_SITES

HOURS = 3600


def frame(seed=1, sites=(("a", 300), ("b", 7), ("c", 2), ("d", 1)), keep=0.6):
    """Irregular hourly rows per site; `a` holds almost all of them."""
    rng = np.random.default_rng(seed)
    parts = []
    for name, n in sites:
        times = pd.date_range("2024-01-01", periods=int(n / keep) + 1, freq="h")
        times = times[np.sort(rng.choice(len(times), n, replace=False))]
        parts.append(pd.DataFrame({"site": name, "time": times, "y": rng.normal(size=n)}))
    df = pd.concat(parts, ignore_index=True)
    df["time"] = df["time"].astype("datetime64[us]")
    return df.sample(frac=1, random_state=seed, ignore_index=True)


@pytest.mark.parametrize("slot", [5 * HOURS, 48 * HOURS, 4096 * HOURS])
def test_positions(spark, slot):
    pdf = frame()
    made = with_positions(spark.createDataFrame(pdf), ["site"], slot_seconds=slot).toPandas()
    for _, g in made.sort_values("time").groupby("site"):
        assert g.pos.tolist() == list(range(len(g)))
        assert (g.n == len(g)).all()
    assert len(made) == len(pdf)


def test_times_before_1970(spark):
    df = spark.sql(
        "select 'a' as site, timestamp_ntz '1969-12-31 22:00:00' + make_dt_interval(0, id) as time"
        " from range(6)"
    )
    made = with_positions(df, ["site"], slot_seconds=3 * HOURS).orderBy("time").toPandas()
    assert made.pos.tolist() == list(range(6))


def test_positions_by_range(spark):
    pdf = frame()
    made = with_positions(spark.createDataFrame(pdf), ["site"]).toPandas()
    for _, g in made.sort_values("time").groupby("site"):
        assert g.pos.tolist() == list(range(len(g)))
        assert (g.n == len(g)).all()
    assert len(made) == len(pdf)


def test_a_burst_and_one_far_row(spark):
    """A million rows within one second and one row years off: ranges cut the burst."""
    burst = spark.range(1_000_000).selectExpr(
        "'a' as site", "timestampadd(microsecond, id, timestamp_ntz'2024-01-01 00:00:00') as time", "id"
    )
    far = spark.sql("select 'a' as site, timestamp_ntz'2034-01-01 00:00:00' as time, 1000000L as id")
    made = with_positions(burst.union(far), ["site"]).persist()
    assert made.filter("pos = id and n = 1000001").count() == 1_000_001
    assert max(r["count"] for r in made.groupBy("site", "slot").count().collect()) <= 4096
    made.unpersist()
    folds = contiguous_folds(burst.union(far), ["site"], 3).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in folds} == {0: 333_334, 1: 333_334, 2: 333_333}
    smooth = moving_average(burst.union(far).selectExpr("site", "time", "id + 0.0 as y"), "y", 3)
    assert smooth.filter("y = 999998.0").count() == 1


def test_no_window_over_a_site(spark):
    """Windows run over one (key, time), or over one row for each key and range."""
    df = spark.createDataFrame(frame())
    plan = with_positions(df, ["site"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan  # the rows are stored in order before that


def test_rows_without_a_time(spark):
    pdf = frame(sites=(("a", 20), ("b", 3)))
    pdf.loc[4, "time"] = pd.NaT
    made = with_positions(spark.createDataFrame(pdf), ["site"]).toPandas()
    timed = made[made.time.notna()].sort_values("time")
    for _, g in timed.groupby("site"):
        assert g.pos.tolist() == list(range(len(g)))
    assert made[made.time.isna()].pos.isna().all() and len(made) == len(pdf)


def test_empty(spark):
    df = spark.createDataFrame(frame()).limit(0)
    assert with_positions(df, ["site"]).count() == 0


def test_duplicate_position_key_fails(spark):
    pdf = frame()
    doubled = spark.createDataFrame(pd.concat([pdf, pdf.head(1)]))
    with pytest.raises(PySparkException, match="duplicate row order key"):
        with_positions(doubled, ["site"]).collect()


@pytest.mark.parametrize("folds", [2, 3, 4])
def test_folds(spark, folds):
    made = contiguous_folds(
        spark.createDataFrame(frame()), ["site"], folds, slot_seconds=10 * HOURS
    ).toPandas()
    for _, g in made.sort_values("time").groupby("site"):
        want = np.concatenate(
            [np.full(len(p), i) for i, p in enumerate(np.array_split(np.arange(len(g)), folds))]
        )
        assert g.fold.tolist() == want.tolist()


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5, 8])
@pytest.mark.parametrize("block", [8, 64, 4096])
def test_moving_average(spark, window, block):
    pdf = frame(3)
    made = moving_average(
        spark.createDataFrame(pdf), "y", window, block=block, slot_seconds=20 * HOURS
    ).toPandas()
    assert len(made) == len(pdf)
    merged = made.merge(pdf, on=["site", "time"], suffixes=("", "_0")).sort_values("time")
    for _, g in merged.groupby("site"):
        y = g.y_0.to_numpy()
        want = y if len(y) < window else np.convolve(y, np.ones(window) / window, mode="same")
        np.testing.assert_allclose(g.y, want, atol=1e-12)


@pytest.mark.parametrize("slot_rows", [3, 50, 4096, None])
def test_interpolate_like_pandas(spark, slot_rows):
    rng = np.random.default_rng(5)
    pdf = frame(4)
    pdf["z"] = np.where(rng.random(len(pdf)) < 0.7, np.nan, pdf.y)
    pdf["y"] = np.where(rng.random(len(pdf)) < 0.3, np.nan, pdf.y)
    pdf["empty"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    by_clock = {"slot_seconds": slot_rows * HOURS} if slot_rows else {}
    made = interpolate(df, ["y", "z", "empty"], **by_clock).toPandas()
    pdf = pdf.sort_values(["site", "time"], ignore_index=True)
    made = made.sort_values(["site", "time"], ignore_index=True)
    for c in ("y", "z", "empty"):
        want = pdf.groupby("site")[c].transform(lambda s: s.interpolate(method="linear"))
        np.testing.assert_allclose(made[c].astype(float), want, atol=1e-9)


@pytest.mark.parametrize("slot_rows", [7, 4096])
def test_spine_and_interpolate_like_reindex(spark, slot_rows):
    pdf = frame(6, sites=(("a", 100), ("b", 40)))
    bounds = spark.sql(
        "select * from values ('a', timestamp_ntz '2024-01-01 05:00:00', timestamp_ntz"
        " '2024-01-06 23:00:00'), ('b', timestamp_ntz '2023-12-31 20:00:00', timestamp_ntz"
        " '2024-01-02 01:00:00') t(site, lo, hi)"
    )
    full = on_spine(spark.createDataFrame(pdf), bounds)
    made = interpolate(full, ["y"], pos="pos", slot_rows=slot_rows).toPandas()
    spans = {"a": ("2024-01-01 05:00", "2024-01-06 23:00"), "b": ("2023-12-31 20:00", "2024-01-02 01:00")}
    for site, (lo, hi) in spans.items():
        hours = pd.date_range(lo, hi, freq="h")
        want = pdf[pdf.site == site].set_index("time").y.reindex(hours).interpolate()
        got = made[made.site == site].set_index("time").y.sort_index()
        assert got.index.tolist() == hours.tolist()
        np.testing.assert_allclose(got, want, atol=1e-9)


def test_spine_of_the_default_sites(spark):
    counts = {r.site: r["count"] for r in spine(spine_bounds(spark, DEFAULT_SITES)).groupBy("site").count().collect()}
    assert counts == {"yeongdeok": 8760, "yangyang": 8759}


def test_duplicate_hour_fails(spark):
    pdf = frame(sites=(("a", 10),))
    bounds = spark.createDataFrame(
        [("a", pdf.time.min().to_pydatetime(), pdf.time.max().to_pydatetime())],
        "site string, lo timestamp_ntz, hi timestamp_ntz",
    )
    with pytest.raises(PySparkException, match="duplicate row for site"):
        on_spine(spark.createDataFrame(pd.concat([pdf, pdf.head(1)])), bounds).collect()


def test_slots_follow_the_rows(spark):
    """A million rows a second apart, a site of hours and one of few rows: no slot is large."""
    dense = spark.range(1_000_000).selectExpr(
        "'a' as site", "timestampadd(second, id, timestamp_ntz'2024-01-01 00:00:00') as time", "id"
    )
    hours = spark.range(300).selectExpr(
        "'b' as site", "timestampadd(hour, id, timestamp_ntz'2024-01-01 00:00:00') as time", "id"
    )
    single = spark.sql("select 'c' as site, timestamp_ntz'2024-01-01 00:00:00' as time, 0L as id")
    made = with_positions(dense.union(hours).union(single), ["site"]).persist()
    assert made.filter("pos = id").count() == 1_000_301
    largest = max(r["count"] for r in made.groupBy("site", "slot").count().collect())
    assert largest <= 4096
    made.unpersist()
