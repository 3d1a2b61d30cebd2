import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windspan.functions.output import HIGH, LOW
from windspan.operators import dual, models, search
from windspan.operators.rows import contiguous_folds

FEATURES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.3] + [2020.0, -3.0, 0.0]
    y = 40 + 6 * (x[:, 0] - 2020) - 2 * x[:, 1] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(flat=7.0, energy_kwh=y, site="s")
    pdf["time"] = pd.date_range("2024-01-01", periods=n, freq="h").astype("datetime64[us]")
    return pdf, spark.createDataFrame(pdf).cache()


def gradient_gap(pdf, w, intercept, alpha, l1_ratio):
    """How far a solution is from the optimum's conditions (zero at the optimum)."""
    x, y = pdf[FEATURES].to_numpy(), pdf.energy_kwh.to_numpy()
    off = y - x @ w - intercept
    slope = (x - x.mean(axis=0)).T @ off / len(y) - alpha * (1 - l1_ratio) * w
    l1 = alpha * l1_ratio
    gap = np.where(w != 0, np.abs(slope - l1 * np.sign(w)), np.maximum(np.abs(slope) - l1, 0))
    return max(gap.max(), abs(off.mean()))


@pytest.mark.parametrize(
    "kind, alpha, l1_ratio",
    [("elasticnet", 0.5, 0.3), ("elasticnet", 20.0, 0.9), ("lasso", 0.7, 1.0), ("ridge", 6.0, 0.0)],
)
def test_linear_fits_are_optimal(data, kind, alpha, l1_ratio):
    pdf, df = data
    model = models.fit_linear(models.assemble(df, FEATURES), kind, alpha, l1_ratio)
    weights = np.array(model.coefficients)
    a = alpha / len(pdf) if kind == "ridge" else alpha
    assert gradient_gap(pdf, weights, model.intercept, a, l1_ratio) < 1e-5
    assert weights[3] == 0


@pytest.mark.parametrize(
    "kind, alpha, l1_ratio",
    [("elasticnet", 0.5, 0.3), ("elasticnet", 20.0, 0.9), ("lasso", 0.7, 1.0), ("ridge", 6.0, 0.0)],
)
def test_moments_give_the_same_fit(data, kind, alpha, l1_ratio):
    pdf, df = data
    ready = df.withColumns({"regime": F.lit(HIGH), "fold": (F.hour("time") % 3).cast("int")})
    centre, moments = search.fold_moments(ready, FEATURES)
    w, intercept = search.solve_linear(sum(moments.values()), kind, alpha, l1_ratio)
    model = models.fit_linear(models.assemble(df, FEATURES), kind, alpha, l1_ratio)
    np.testing.assert_allclose(w, np.array(model.coefficients), atol=1e-5)
    whole = centre[-1] + intercept - w @ centre[:-1]
    assert whole == pytest.approx(model.intercept, abs=1e-2)


def test_missing_feature_fails(data):
    _, df = data
    holed = df.withColumn("a", F.when(F.hour("time") > 1, F.col("a")))
    with pytest.raises(Exception):
        models.fit_linear(models.assemble(holed, FEATURES), "ridge", 1.0)


def test_draws_are_seeded_and_in_range():
    space = search.SPACES["rf"][HIGH]
    drawn = search.draw(space, 50)
    assert drawn == search.draw(space, 50)
    assert drawn != search.draw(space, 50, seed=1)
    assert all(300 <= d["n_estimators"] < 700 for d in drawn)
    assert {d["max_depth"] for d in drawn} == {20, 25, 30, None}
    nets = search.draw(search.SPACES["elasticnet"][LOW], 50)
    assert all(0.001 <= d["alpha"] <= 20.001 and 0 <= d["l1_ratio"] <= 1 for d in nets)
    settings = search.SearchSettings()
    assert settings.n_draws("rf", HIGH) == 20
    assert settings.n_draws("elasticnet", LOW) == 15
    assert settings.n_draws("ridge", LOW) == 7


@pytest.mark.parametrize("kind", ["svr", "mlp", "magic"])
def test_unknown_model(data, kind):
    with pytest.raises(ValueError, match="unsupported model type"):
        dual.fit_dual(data[1], FEATURES, 50.0, kind)


def test_tree_settings():
    rf = models.tree_estimator("rf")
    made = models.tree_params(
        rf, {"n_estimators": 9, "max_depth": None, "min_samples_leaf": 3, "max_features": "sqrt"}
    )
    assert made == {
        rf.numTrees: 9,
        rf.maxDepth: 30,
        rf.minInstancesPerNode: 3,
        rf.featureSubsetStrategy: "sqrt",
    }
    gbt = models.tree_estimator("lgbm")
    drawn = search.draw(search.SPACES["lgbm"][HIGH], 1)[0]
    made = models.tree_params(gbt, drawn)
    assert made[gbt.maxIter] == drawn["n_estimators"]
    assert made[gbt.stepSize] == drawn["learning_rate"]
    assert 0 < float(made[gbt.featureSubsetStrategy]) <= 1


def test_search_scores_by_hand(data):
    """Cross-validated errors against separate fits of every fold."""
    pdf, df = data
    ready = contiguous_folds(df.withColumn("regime", F.lit(HIGH)), ["site", "regime"], 3).cache()
    settings = search.SearchSettings(draws={HIGH: 3, LOW: 3})
    found = search.search(ready, FEATURES, "elasticnet", [HIGH], settings)[HIGH]
    folds = np.array_split(np.arange(len(pdf)), 3)
    for params, score in found.tried:
        errors = []
        for hold in folds:
            kept = ready.filter(F.col("fold") != next(i for i, f in enumerate(folds) if f is hold))
            model = models.fit_linear(
                models.assemble(kept, FEATURES), "elasticnet", params["alpha"], params["l1_ratio"]
            )
            x = pdf[FEATURES].to_numpy()[hold]
            off = pdf.energy_kwh.to_numpy()[hold] - x @ np.array(model.coefficients) - model.intercept
            errors.append(np.abs(off).mean())
        assert score == pytest.approx(np.mean(errors), rel=1e-5)
    assert found.mae == min(s for _, s in found.tried)


SMALL = search.SearchSettings(
    draws={HIGH: 2, LOW: 2},
    spaces={
        kind: {
            r: {
                "n_estimators": search.Whole(3, 5),
                "max_depth": [2, 3],
                "learning_rate": search.Real(0.1, 0.1),
                "subsample": search.Real(0.8, 0.2),
            }
            for r in (HIGH, LOW)
        }
        for kind in ("rf", "xgb")
    },
)


@pytest.mark.parametrize("kind", ["rf", "xgb", "elasticnet", "lasso", "ridge"])
def test_dual_model(data, kind):
    pdf, df = data
    cap = float(pdf.energy_kwh.max() * 1.04)
    some_missing = df.withColumn(
        "energy_kwh", F.when(F.hour("time") != 3, F.col("energy_kwh"))
    )
    model = dual.fit_dual(some_missing, FEATURES, cap, kind, SMALL, share=0.6)
    assert sum(model.counts.values()) == 575
    made = model.score(df).toPandas()
    want = np.where(made.p_high >= 0.6 * cap, made.p_high, made.p_low)
    np.testing.assert_array_equal(made.prediction, want)
    assert len(made) == len(pdf)
    assert model.high.mae < pdf.energy_kwh.std()


def test_empty_regime_uses_the_other_model(data):
    pdf, df = data
    with pytest.raises(ValueError, match="0 in regime low"):
        dual.fit_dual(df, FEATURES, 1e-6, "ridge", SMALL)
    model = dual.fit_dual(df, FEATURES, 1e-6, "ridge", SMALL, other_for_empty=True)
    assert model.low is model.high
    made = model.score(df).toPandas()
    np.testing.assert_array_equal(made.p_low, made.p_high)
    with pytest.raises(ValueError, match="too few rows"):
        dual.fit_dual(df.filter("false"), FEATURES, 1.0, "ridge", SMALL)


def test_small_regime_fails_where_there_is_a_choice(data):
    pdf, df = data
    cap = float(np.sort(pdf.energy_kwh)[2])  # two rows below, the rest above
    with pytest.raises(ValueError, match="2 in regime low"):
        dual.fit_dual(df, FEATURES, cap, "ridge", SMALL, share=1.0)
    one = search.SearchSettings(
        draws={HIGH: 1, "low": 1}, spaces={"ridge": {r: {"alpha": [1.0]} for r in (HIGH, "low")}}
    )
    model = dual.fit_dual(df, FEATURES, cap, "ridge", one, share=1.0)
    assert model.counts == {"high": len(pdf) - 2, "low": 2} and model.low is not model.high


def test_small_spread_beside_a_large_one():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(0, 1e-3, 500), rng.normal(0, 2000, 500), np.full(500, 7.0)])
    y = 1e6 * x[:, 0]
    rows = np.column_stack([np.ones(500), x - x.mean(axis=0), y - y.mean()])
    w, _ = search.solve_linear(rows.T @ rows, "elasticnet", 1e-9, 0.5)
    assert w[0] == pytest.approx(1e6, rel=0.01) and w[2] == 0


@pytest.mark.parametrize("kind,alpha,ratio", [("elasticnet", 0.3, 0.95), ("elasticnet", 1e-3, 0.5), ("lasso", 0.5, 1.0)])
def test_features_that_nearly_repeat_each_other(kind, alpha, ratio):
    """Sweeps crawl here; the optimum's own conditions must hold."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 12)) * 10.0 ** rng.uniform(-2, 3, 12)
    x[:, 3] = x[:, 2] * (1 + 1e-6 * rng.normal(size=60))
    x[:, 4] = x[:, 2] ** 2
    x[:, 5] = x[:, 0] + x[:, 1]
    y = x @ rng.normal(size=12) + rng.normal(size=60)
    rows = np.column_stack([np.ones(60), x - x.mean(axis=0), y - y.mean()])
    w, _ = search.solve_linear(rows.T @ rows, kind, alpha, ratio)
    l1, l2 = alpha * ratio if kind == "elasticnet" else alpha, alpha * (1 - ratio)
    slope = (rows[:, 1:-1].T @ (rows[:, -1] - rows[:, 1:-1] @ w)) / 60 - l2 * w
    room = 1e-6 * (x.std(axis=0) * y.std() + l1)
    assert (np.abs(slope - l1 * np.sign(w)) <= room)[w != 0].all()
    assert (np.abs(slope) <= l1 + room)[w == 0].all()


def test_sweeps_that_do_not_settle_fail():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 5))
    x[:, 1] = x[:, 0] + 1e-3 * x[:, 1]
    rows = np.column_stack([np.ones(50), x, x @ np.arange(5.0)])
    with pytest.raises(ArithmeticError, match="did not settle"):
        search.solve_linear(rows.T @ rows, "lasso", 1e-6, sweeps=3)


def test_too_deep_trees_fail():
    with pytest.raises(ValueError, match="31"):
        models.tree_params(models.tree_estimator("rf"), {"n_estimators": 3, "max_depth": 31})
