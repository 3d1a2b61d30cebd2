"""Randomised parameter search: seeded draws, contiguous folds, lowest mean absolute error."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windspan.functions.output import HIGH, LOW
from windspan.operators.models import (
    LABEL,
    LINEAR,
    PREDICTION,
    SEED,
    TREES,
    assemble,
    fit_linear,
    tree_estimator,
    tree_params,
)
from windspan.session import side_by_side


# Functions sent to executors carry their helpers, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Whole:
    """A whole number from low up to but excluding high."""

    low: int
    high: int


@dataclass(frozen=True)
class Real:
    """A number from low to low + width."""

    low: float
    width: float


# The parameter ranges tried for each model and regime. min_samples_split,
# num_leaves, solver and selection have no counterpart in Spark; they are drawn all the same,
# so that one seed gives the same candidates whatever is done with them.
SPACES = {
    "rf": {
        HIGH: {
            "n_estimators": Whole(300, 700),
            "max_depth": [20, 25, 30, None],
            "min_samples_split": Whole(2, 10),
            "min_samples_leaf": Whole(1, 5),
            "max_features": ["sqrt", "log2"],
        },
        LOW: {
            "n_estimators": Whole(100, 400),
            "max_depth": [10, 15, 20, None],
            "min_samples_split": Whole(2, 15),
            "min_samples_leaf": Whole(1, 8),
            "max_features": ["sqrt", "log2"],
        },
    },
    "lgbm": {
        HIGH: {
            "n_estimators": Whole(300, 700),
            "max_depth": Whole(8, 20),
            "learning_rate": Real(0.01, 0.15),
            "num_leaves": Whole(50, 150),
            "min_child_samples": Whole(5, 50),
            "subsample": Real(0.75, 0.25),
            "colsample_bytree": Real(0.75, 0.25),
        },
        LOW: {
            "n_estimators": Whole(100, 400),
            "max_depth": Whole(5, 15),
            "learning_rate": Real(0.01, 0.2),
            "num_leaves": Whole(20, 100),
            "min_child_samples": Whole(10, 80),
            "subsample": Real(0.7, 0.3),
            "colsample_bytree": Real(0.7, 0.3),
        },
    },
    "xgb": {
        HIGH: {
            "n_estimators": Whole(300, 700),
            "max_depth": Whole(8, 20),
            "learning_rate": Real(0.01, 0.15),
            "subsample": Real(0.75, 0.25),
            "colsample_bytree": Real(0.75, 0.25),
        },
        LOW: {
            "n_estimators": Whole(100, 400),
            "max_depth": Whole(5, 15),
            "learning_rate": Real(0.01, 0.2),
            "subsample": Real(0.7, 0.3),
            "colsample_bytree": Real(0.7, 0.3),
        },
    },
    "ridge": {
        HIGH: {
            "alpha": Real(0.1, 10.0),
            "solver": ["auto", "svd", "cholesky", "lsqr", "sag", "saga"],
        },
        LOW: {
            "alpha": Real(0.01, 5.0),
            "solver": ["auto", "svd", "cholesky", "lsqr", "sag", "saga"],
        },
    },
    "elasticnet": {
        HIGH: {
            "alpha": Real(0.001, 50.0),
            "l1_ratio": Real(0.0, 1.0),
            "selection": ["cyclic", "random"],
        },
        LOW: {
            "alpha": Real(0.001, 20.0),
            "l1_ratio": Real(0.0, 1.0),
            "selection": ["cyclic", "random"],
        },
    },
    "lasso": {
        HIGH: {"alpha": Real(0.1, 10.0), "selection": ["cyclic", "random"]},
        LOW: {"alpha": Real(0.01, 5.0), "selection": ["cyclic", "random"]},
    },
}
# Candidates per regime; ridge tries fewer for the low one.
DRAWS = {HIGH: 20, LOW: 15}
RIDGE_LOW_DRAWS = 7

# Of the label's deviation: how far the last sweep may move a feature's part of the fit, at most.
UNSETTLED = 1e-4


@dataclass(frozen=True)
class SearchSettings:
    folds: int = 3
    seed: int = SEED
    parallelism: int = 4
    draws: dict | None = None
    spaces: dict = field(default_factory=dict)

    def space(self, kind: str, regime: str) -> dict:
        return self.spaces.get(kind, SPACES[kind])[regime]

    def n_draws(self, kind: str, regime: str) -> int:
        if self.draws is not None:
            return self.draws[regime]
        return RIDGE_LOW_DRAWS if kind == "ridge" and regime == LOW else DRAWS[regime]


def check_kind(kind: str) -> None:
    if kind not in LINEAR + TREES:
        raise ValueError(f"unsupported model type: {kind}")


def draw(space: dict, n: int, seed: int = SEED) -> list[dict]:
    """`n` candidates, each parameter drawn in order of name from one seeded generator."""
    rng = np.random.RandomState(seed)

    def one(spec):
        if isinstance(spec, Whole):
            return int(rng.randint(spec.low, spec.high))
        if isinstance(spec, Real):
            return spec.low + spec.width * rng.uniform()
        return spec[rng.randint(len(spec))]

    return [{name: one(space[name]) for name in sorted(space)} for _ in range(n)]


@dataclass
class Chosen:
    """The best candidate of one regime, refitted on all of its rows."""

    regime: str
    params: dict
    mae: float
    model: object
    tried: list[tuple[dict, float]]


def search_trees(train: DataFrame, kind: str, regime: str, settings: SearchSettings) -> Chosen:
    """`train` is assembled and holds `fold`."""
    estimator = tree_estimator(kind, seed=settings.seed)
    drawn = draw(settings.space(kind, regime), settings.n_draws(kind, regime), settings.seed)
    fitted = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=[tree_params(estimator, d) for d in drawn],
        evaluator=RegressionEvaluator(
            labelCol=LABEL, predictionCol=PREDICTION, metricName="mae"
        ),
        numFolds=settings.folds,
        foldCol="fold",
        parallelism=settings.parallelism,
        seed=settings.seed,
    ).fit(train)
    best = int(np.argmin(fitted.avgMetrics))
    return Chosen(
        regime,
        drawn[best],
        float(fitted.avgMetrics[best]),
        fitted.bestModel,
        list(zip(drawn, map(float, fitted.avgMetrics))),
    )


def fold_moments(
    train: DataFrame, features: Sequence[str], label: str = LABEL
) -> tuple[np.ndarray, dict[tuple[str, int], np.ndarray]]:
    """Cross-products of (1, features, label) per regime and fold, about the overall means.

    Every linear fit of the search follows from these, so its cost in passes over the rows
    does not depend on how many candidates and folds there are. A task sends one small matrix
    per regime and fold; the sums are combined before and after the shuffle.
    """
    names = [*features, label]
    means = train.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
    centre = np.array([m or 0.0 for m in means])
    width = len(names) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            rows = batch[names].to_numpy(dtype=float) - centre
            rows = np.hstack([np.ones((len(rows), 1)), rows])
            for key, at in batch.groupby(["regime", "fold"]).indices.items():
                part = rows[at]
                sums[key] = sums.get(key, 0.0) + part.T @ part
        for (regime, fold), m in sums.items():
            yield pd.DataFrame(
                {"regime": regime, "fold": fold, "cell": np.arange(m.size), "v": m.ravel()}
            )

    total = (
        train.select("regime", "fold", *[F.col(f"`{c}`") for c in names])
        .mapInPandas(partial, "regime string, fold int, cell int, v double")
        .groupBy("regime", "fold", "cell")
        .agg(F.sum("v").alias("v"))
    )
    # At most two regimes x folds x (features + 2)^2 numbers.
    out: dict[tuple[str, int], np.ndarray] = {}
    for r in total.toPandas().itertuples():
        out.setdefault((r.regime, r.fold), np.zeros(width * width))[r.cell] = r.v
    return centre, {k: v.reshape(width, width) for k, v in out.items()}


def _optimum(c, b, l1: float, l2: float, live, signs) -> np.ndarray | None:
    """The optimum, if its weights have these signs: sweeps crawl along features that nearly
    repeat each other, though the signs are soon right."""
    on = live[signs[live] != 0]
    w = np.zeros(len(b))
    w[on] = np.linalg.lstsq(
        c[np.ix_(on, on)] + l2 * np.eye(len(on)), b[on] - l1 * signs[on], rcond=None
    )[0]
    slope = (b - c @ w - l2 * w)[live]
    room = 1e-9 * np.abs(b[live]) + 1e-12 * np.abs(c[live]) @ np.abs(w)
    signed = (np.sign(w[on]) == signs[on]).all()
    met = np.abs(slope - l1 * np.sign(w[live])) <= room
    within = (w[live] == 0) & (np.abs(slope) <= l1 + room)
    return w if signed and (met | within).all() else None


def _searched_signs(c, b, l1: float, l2: float, live, w) -> np.ndarray:
    """The signs of the optimum, by exact steps from one set of signs to the next.

    For the present signs the optimum is a linear system. A step goes towards it, to the lowest point
    among its end and the places where a weight passes zero; at an optimum for its signs, the zero
    weight that pulls hardest is let in. The objective falls at each step, so no set returns.
    """
    s = np.sqrt(np.diag(c)[live])
    q, bb = c[np.ix_(live, live)] / np.outer(s, s) + np.diag(l2 / s**2), b[live] / s
    pull, now = l1 / s, w[live] * s
    room = 1e-11 * max(np.abs(bb).max(initial=0.0), 1e-300)

    def worth(x):
        return 0.5 * x @ q @ x - bb @ x + pull @ np.abs(x)

    for _ in range(100 * max(len(s), 1)):
        slope, signs = q @ now - bb, np.sign(now)
        if np.all(np.abs(slope + pull * signs)[signs != 0] <= room):
            strain = np.where(signs == 0, np.abs(slope) - pull, -np.inf)
            if strain.max(initial=-np.inf) <= room:
                break
            signs[strain.argmax()] = -np.sign(slope[strain.argmax()])
        on = signs != 0
        goal = np.zeros_like(now)
        goal[on] = np.linalg.lstsq(q[np.ix_(on, on)], bb[on] - pull[on] * signs[on], rcond=None)[0]
        ends = [goal]
        for i in np.flatnonzero(now * goal < 0):
            end = now + (goal - now) * now[i] / (now[i] - goal[i])
            end[i] = 0.0
            ends.append(end)
        best = min(ends, key=worth)
        if worth(best) >= worth(now):
            break
        now = best
    found = np.zeros_like(w)
    found[live] = np.sign(now)
    return found


def solve_linear(
    moments: np.ndarray, kind: str, alpha: float, l1_ratio: float = 0.5, sweeps: int = 5000
) -> tuple[np.ndarray, float]:
    """Weights and intercept from the cross-products of (1, features, label)."""
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    spread = moments[1:, 1:] / n - np.outer(mean, mean)
    c, b = spread[:-1, :-1], spread[:-1, -1]
    d = len(b)
    if kind == "ridge":
        w = np.linalg.lstsq(c + alpha / n * np.eye(d), b, rcond=None)[0]
    else:
        l1 = alpha * (1.0 if kind == "lasso" else l1_ratio)
        l2 = alpha - l1
        scale = np.diag(c) + l2
        # A feature that is constant here, against its own size about the overall mean.
        own = np.diag(moments)[1:-1] / n
        live = np.flatnonzero(np.diag(c) > 1e-12 * own)
        w = np.zeros(d)
        fit = np.zeros(d)
        for sweep in range(1, sweeps + 1):
            moved = 0.0
            for j in live:
                pull = b[j] - fit[j] + c[j, j] * w[j]
                new = np.sign(pull) * max(abs(pull) - l1, 0.0) / scale[j]
                if new != w[j]:
                    step = new - w[j]
                    fit += c[:, j] * step
                    moved = max(moved, abs(step) * np.sqrt(c[j, j]))
                    w[j] = new
            if moved <= 1e-10 * np.sqrt(max(spread[-1, -1], 1e-300)):
                break
            if sweep % 50 == 0:
                exact = _optimum(c, b, l1, l2, live, np.sign(w))
                if exact is None:
                    signs = _searched_signs(c, b, l1, l2, live, w)
                    exact = _optimum(c, b, l1, l2, live, signs)
                if exact is not None:
                    w = exact
                    break
        else:
            if moved > UNSETTLED * np.sqrt(spread[-1, -1]):
                raise ArithmeticError(
                    f"{kind} with alpha {alpha} did not settle in {sweeps} sweeps"
                )
    return w, float(mean[-1] - w @ mean[:-1])


def linear_scores(
    train: DataFrame,
    features: Sequence[str],
    weights: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]],
    centre: np.ndarray,
    label: str = LABEL,
) -> dict[tuple[str, int], np.ndarray]:
    """Mean absolute error of every candidate on every held-out fold, in one pass."""
    names = [*features, label]

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            rows = batch[names].to_numpy(dtype=float) - centre
            for key, at in batch.groupby(["regime", "fold"]).indices.items():
                w, intercept = weights[key]
                off = np.abs(rows[at, :-1] @ w + intercept - rows[at, -1:]).sum(axis=0)
                sums[key] = sums.get(key, 0.0) + np.append(off, len(at))
        for (regime, fold), s in sums.items():
            yield pd.DataFrame(
                {
                    "regime": regime,
                    "fold": fold,
                    "candidate": np.arange(len(s) - 1),
                    "off": s[:-1],
                    "rows": s[-1],
                }
            )

    total = (
        train.select("regime", "fold", *[F.col(f"`{c}`") for c in names])
        .mapInPandas(
            errors, "regime string, fold int, candidate int, off double, rows double"
        )
        .groupBy("regime", "fold", "candidate")
        .agg((F.sum("off") / F.sum("rows")).alias("mae"))
    )
    out: dict[tuple[str, int], dict[int, float]] = {}
    for r in total.toPandas().itertuples():
        out.setdefault((r.regime, r.fold), {})[r.candidate] = r.mae
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def search_linear(
    train: DataFrame,
    features: Sequence[str],
    kind: str,
    regimes: Sequence[str],
    settings: SearchSettings,
) -> list[Chosen]:
    """Search both regimes together: one pass for means, one for moments, one for scores."""
    train = train.filter(F.col("regime").isin(list(regimes)))
    drawn = {
        r: draw(settings.space(kind, r), settings.n_draws(kind, r), settings.seed) for r in regimes
    }
    counts = regime_rows(train)
    # With one candidate there is nothing to choose: fewer rows than folds will do.
    scored = [r for r in regimes if len(drawn[r]) > 1 or counts[r] >= settings.folds]
    centre, moments = fold_moments(train, features)
    weights = {}
    for regime in scored:
        everything = sum(moments[regime, f] for f in range(settings.folds))
        for f in range(settings.folds):
            fits = [
                solve_linear(
                    everything - moments[regime, f], kind, d["alpha"], d.get("l1_ratio", 1.0)
                )
                for d in drawn[regime]
            ]
            weights[regime, f] = (
                np.column_stack([w for w, _ in fits]),
                np.array([i for _, i in fits]),
            )
    rows = train.filter(F.col("regime").isin(scored))
    scores = linear_scores(rows, features, weights, centre) if scored else {}

    def refit(regime: str) -> Chosen:
        mae = np.full(len(drawn[regime]), np.nan)
        if regime in scored:
            mae = np.mean([scores[regime, f] for f in range(settings.folds)], axis=0)
        best = int(np.argmin(mae))
        params = drawn[regime][best]
        model = fit_linear(
            assemble(train.filter(F.col("regime") == regime), features),
            kind,
            params["alpha"],
            params.get("l1_ratio", 1.0),
        )
        tried = list(zip(drawn[regime], map(float, mae)))
        return Chosen(regime, params, float(mae[best]), model, tried)

    return side_by_side(train.sparkSession, refit, regimes, settings.parallelism)


def regime_rows(train: DataFrame) -> dict[str, int]:
    counts = train.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    return {r["regime"]: r["n"] for r in counts.collect()}


def usable_regimes(
    counts: dict[str, int],
    kind: str,
    settings: SearchSettings,
    where: str = "",
    other_for_empty: bool = False,
) -> list[str]:
    """The regimes to fit. An empty one raises unless the other one's model may stand in; one
    with fewer rows than folds raises if there are candidates to choose from."""
    usable = []
    for r in (HIGH, LOW):
        n = counts.get(r, 0)
        if n == 0 and other_for_empty:
            continue
        if n == 0 or (n < settings.folds and settings.n_draws(kind, r) > 1):
            raise ValueError(f"too few rows to train on: {n} in regime {r}{where}, counts {counts}")
        usable.append(r)
    if not usable:
        raise ValueError(f"too few rows to train on{where}: {counts}")
    return usable


def search(
    train: DataFrame,
    features: Sequence[str],
    kind: str,
    regimes: Sequence[str],
    settings: SearchSettings,
) -> dict[str, Chosen]:
    """Best model per regime. `train` holds the features, the label, `regime` and `fold`."""
    check_kind(kind)
    if kind in LINEAR:
        found = search_linear(train, features, kind, regimes, settings)
    else:
        found = [
            search_trees(
                assemble(train.filter(F.col("regime") == r), features), kind, r, settings
            )
            for r in regimes
        ]
    return {c.regime: c for c in found}
