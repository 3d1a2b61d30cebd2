"""Regression models on Spark ML: linear with an exact penalty, forests, boosted trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL, VECTOR, PREDICTION = "energy_kwh", "features", "prediction"
SEED = 42

LINEAR = ("elasticnet", "lasso", "ridge")
TREES = ("rf", "lgbm", "xgb")

# Spark trees stop at 30 levels; an unlimited depth is taken as that.
DEEPEST = 30


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The feature vector, unscaled. A missing feature fails the job."""
    return VectorAssembler(
        inputCols=list(features), outputCol=VECTOR, handleInvalid="error"
    ).transform(df)


def penalty(alpha: float, l1_ratio: float, label_std: float) -> tuple[float, float]:
    """(regParam, elasticNetParam) for the objective
    1/(2n)|y - Xw|^2 + alpha*l1_ratio*|w|_1 + alpha*(1 - l1_ratio)/2*|w|^2.

    Spark divides the penalty by the label's standard deviation, which leaves the L1 term as it
    is and weakens the L2 term by that factor; this undoes it.
    """
    l1 = alpha * l1_ratio
    strength = l1 + alpha * (1 - l1_ratio) * label_std
    return strength, (l1 / strength if strength > 0 else 0.0)


def _summary(train: DataFrame, label: str) -> tuple[int, float, list[int], int]:
    """Row count, the label's standard deviation, which features vary, and how many there are;
    in one pass."""
    row = train.agg(
        F.count(label).alias("n"),
        F.stddev_pop(F.col(label).cast("double")).alias("spread"),
        Summarizer.metrics("max", "min").summary(F.col(VECTOR)).alias("s"),
    ).first()
    high, low = row.s["max"].toArray(), row.s["min"].toArray()
    live = [i for i in range(len(high)) if high[i] > low[i]]
    return row.n, row.spread or 0.0, live, len(high)


@dataclass
class LinearFit:
    """A fitted linear model over the features that vary; the others have weight 0."""

    model: LinearRegressionModel
    live: list[int]
    width: int

    @property
    def coefficients(self) -> list[float]:
        weights = [0.0] * self.width
        for i, w in zip(self.live, self.model.coefficients):
            weights[i] = float(w)
        return weights

    @property
    def intercept(self) -> float:
        return self.model.intercept

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(_sliced(df, self.live)).drop(_LIVE)


_LIVE = "_live_features"


def _sliced(df: DataFrame, live: list[int]) -> DataFrame:
    return VectorSlicer(inputCol=VECTOR, outputCol=_LIVE, indices=live).transform(df)


def fit_linear(
    train: DataFrame, kind: str, alpha: float, l1_ratio: float = 0.5, label: str = LABEL
) -> LinearFit:
    """Elastic net, lasso or ridge with the usual meaning of alpha. `train` is assembled.

    The solver gathers the feature cross-products in one pass, in partial sums, and solves on
    a matrix whose size is the number of features. A constant feature would make that matrix
    singular, and the solver's way round it applies the penalty twice, so it is left out.
    """
    n, spread, live, width = _summary(train, label)
    if kind == "ridge":
        # Ridge weighs the penalty against the sum of squares, not their mean.
        strength, mix = penalty(alpha / n, 0.0, spread)
    elif kind == "lasso":
        strength, mix = penalty(alpha, 1.0, spread)
    elif kind == "elasticnet":
        strength, mix = penalty(alpha, l1_ratio, spread)
    else:
        raise ValueError(f"not a linear model: {kind}")
    live = live or [0]
    model = LinearRegression(
        featuresCol=_LIVE,
        labelCol=label,
        predictionCol=PREDICTION,
        regParam=strength,
        elasticNetParam=mix,
        standardization=False,
        solver="normal",
        maxIter=2000,
        tol=1e-11,
    ).fit(_sliced(train, live))
    return LinearFit(model, live, width)


def tree_estimator(kind: str, label: str = LABEL, seed: int = SEED):
    if kind == "rf":
        return RandomForestRegressor(
            featuresCol=VECTOR, labelCol=label, predictionCol=PREDICTION, seed=seed
        )
    if kind in ("lgbm", "xgb"):
        return GBTRegressor(
            featuresCol=VECTOR, labelCol=label, predictionCol=PREDICTION, seed=seed
        )
    raise ValueError(f"not a tree model: {kind}")


def tree_params(estimator, drawn: dict) -> dict:
    """A drawn candidate as a Spark param map. Settings Spark trees do not have are left out."""
    boosted = isinstance(estimator, GBTRegressor)
    if (drawn["max_depth"] or DEEPEST) > DEEPEST:
        raise ValueError(f"trees are at most {DEEPEST} deep, not {drawn['max_depth']}")
    made = {
        estimator.maxIter if boosted else estimator.numTrees: int(drawn["n_estimators"]),
        estimator.maxDepth: int(drawn["max_depth"] or DEEPEST),
    }
    leaf = drawn.get("min_samples_leaf", drawn.get("min_child_samples"))
    if leaf is not None:
        made[estimator.minInstancesPerNode] = int(leaf)
    if "max_features" in drawn:
        made[estimator.featureSubsetStrategy] = drawn["max_features"]
    if boosted and "learning_rate" in drawn:
        made[estimator.stepSize] = float(drawn["learning_rate"])
    if "subsample" in drawn:
        made[estimator.subsamplingRate] = float(min(drawn["subsample"], 1.0))
    if "colsample_bytree" in drawn:
        made[estimator.featureSubsetStrategy] = f"{min(drawn['colsample_bytree'], 1.0):.6f}"
    return made
