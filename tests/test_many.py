"""All sites at once against one at a time, and how many jobs that takes."""

import uuid

import numpy as np
import pandas as pd
import pytest

from windspan.operators.dual import fit_dual
from windspan.operators.many import fit_many
from windspan.operators.search import SearchSettings

FEATURES = ["a", "b", "c", "flat", "gone"]


def rows(n_sites, n=90, seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(n_sites):
        x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, i, 1000]
        y = np.abs(50 * x[:, 0] + 3 * x[:, 1] + rng.normal(size=n) * 5 + 60)
        parts.append(
            pd.DataFrame(
                {
                    "site": f"s{i:03}",
                    "time": pd.date_range("2024-01-01", periods=n, freq="h").astype("datetime64[us]"),
                    "a": x[:, 0],
                    "b": x[:, 1],
                    "c": x[:, 2],
                    "flat": 2.5,
                    "gone": np.nan if i % 2 else x[:, 0] ** 2,
                    "energy_kwh": np.where(np.arange(n) % 11 == 0, np.nan, y),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def frame(spark, pdf):
    return spark.createDataFrame(pdf).replace(float("nan"), None)


def caps(df):
    return df.groupBy("site").agg({"energy_kwh": "max"}).withColumnRenamed("max(energy_kwh)", "capacity")


@pytest.mark.parametrize("kind", ["ridge", "elasticnet", "lasso"])
def test_like_one_site_at_a_time(spark, kind):
    df = frame(spark, rows(3))
    settings = SearchSettings(draws={"high": 4, "low": 3})
    many = fit_many(df, FEATURES, caps(df), {f"s{i:03}": kind for i in range(3)}, settings, 0.4)
    scored = many.score(df).toPandas()
    tried = many.tried.toPandas()
    for i in range(3):
        name = f"s{i:03}"
        one = df.filter(f"site = '{name}'")
        known = FEATURES[:4] if i % 2 else FEATURES
        cap = caps(one).first().capacity
        alone = fit_dual(one, known, cap, kind, settings, 0.4)
        want = alone.score(one).toPandas().sort_values("time", ignore_index=True)
        got = scored[scored.site == name].sort_values("time", ignore_index=True)
        for c in ("p_high", "p_low", "prediction"):
            np.testing.assert_allclose(got[c], want[c], rtol=1e-6, atol=1e-6)
        for regime, chosen in (("high", alone.high), ("low", alone.low)):
            some = tried[(tried.site == name) & (tried.regime == regime)].sort_values("candidate")
            np.testing.assert_allclose(some.mae, [m for _, m in chosen.tried], rtol=1e-6)
            picked = many.by_site()[name].regimes[regime]
            assert picked["alpha"] == pytest.approx(chosen.params["alpha"])


def jobs(spark, work):
    """How many Spark jobs a piece of work takes."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_as_many_jobs_for_300_sites_as_for_3(spark):
    settings = SearchSettings(draws={"high": 2, "low": 2})
    counts, models = [], []
    for n in (3, 300):
        df = frame(spark, rows(n, 40))
        kinds = {f"s{i:03}": "ridge" for i in range(n)}

        def work():
            many = fit_many(df, FEATURES, caps(df), kinds, settings, 0.4, other_for_few=True)
            models.append(many.score(df).toPandas())

        spark.conf.set("spark.sql.adaptive.enabled", "false")  # its stages count as jobs
        counts.append(jobs(spark, work))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert counts[0] == counts[1]
    assert len(models[1]) == 300 * 40 and models[1].prediction.notna().all()


def test_missing_values_and_regimes_are_named(spark):
    pdf = rows(2)
    settings = SearchSettings(draws={"high": 2, "low": 2})
    kinds = {"s000": "ridge", "s001": "ridge"}
    holes = pdf.copy()
    holes.loc[5, "b"] = np.nan
    df = frame(spark, holes)
    with pytest.raises(ValueError, match="s000: b"):
        fit_many(df, FEATURES, caps(df), kinds, settings)
    df = frame(spark, pdf)
    with pytest.raises(ValueError, match="too few rows"):
        fit_many(df, FEATURES, caps(df), kinds, settings, share=0.0)
    made = fit_many(df, FEATURES, caps(df), kinds, settings, share=0.0, other_for_empty=True)
    assert made.score(df).filter("p_high <> p_low").isEmpty()
    with pytest.raises(ValueError, match="s009"):
        fit_many(df, FEATURES, caps(df), {**kinds, "s009": "ridge"}, settings, 0.4)
    with pytest.raises(ValueError, match="rf"):
        fit_many(df, FEATURES, caps(df), {**kinds, "s001": "rf"}, settings, 0.4)


def test_few_rows_are_left_to_the_other_regime(spark):
    pdf = rows(1)
    cap = pdf.energy_kwh.max()
    order = np.sort(pdf.energy_kwh.dropna())
    df = frame(spark, pdf)
    share = float((order[1] + 1e-9) / cap)  # two rows are low
    kinds = {"s000": "elasticnet"}
    with pytest.raises(ValueError, match="too few rows"):
        fit_many(df, FEATURES, caps(df), kinds, None, share)
    made = fit_many(df, FEATURES, caps(df), kinds, None, share, other_for_few=True)
    assert set(made.by_site()["s000"].regimes) == {"high"}


def test_a_row_that_lacks_a_weighted_feature_fails(spark):
    df = frame(spark, rows(1))
    many = fit_many(df, FEATURES, caps(df), {"s000": "ridge"}, SearchSettings(draws={"high": 1, "low": 1}), 0.4)
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    with pytest.raises(PySparkException, match="missing features for site s000"):
        many.score(df.withColumn("a", F.lit(None).cast("double"))).collect()
    assert many.score(df.withColumn("flat", F.lit(None).cast("double"))).filter("prediction is null").isEmpty()
