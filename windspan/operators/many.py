"""Linear models of all sites, regimes and folds in one pass of a fixed number of jobs.

One row a (site, regime, fold) gathers counts, ranges and cross-products. Every fit of the search
follows from these: tasks solve all candidates of a (site, regime) for each left-out fold and for all
rows. The weights become a table of one row a (site, regime, fold) that is joined to the rows to score
them, broadcast if its size is known to be small and shuffled by salted keys otherwise. Neither the
number of jobs nor what the driver holds grows with the number of sites.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windspan.functions.output import HIGH, HIGH_SHARE, LOW, gate, regime
from windspan.operators.joins import attach_per_key
from windspan.operators.models import LABEL, LINEAR, PREDICTION
from windspan.operators.rows import contiguous_folds
from windspan.operators.search import SearchSettings, draw, solve_linear
from windspan.session import written

# Functions sent to executors carry their helpers, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["site", "regime", "fold"]
HELD_BYTES = 64 << 20  # cross-products a task holds before it passes them on
ROW_BYTES = 64  # what attach_per_key takes one row of a table to be
ALL = -1  # the fold of fits on all rows


@dataclass
class ManyModels:
    """Weights of the chosen candidates, one row a (site, regime), and the scores of all."""

    features: list[str]
    share: float
    capacities: DataFrame  # site, capacity
    chosen: DataFrame  # site, regime, candidate, alpha, l1_ratio, mae, n, intercept, weights
    tried: DataFrame  # site, regime, candidate, alpha, l1_ratio, mae

    def score(self, rows: DataFrame) -> DataFrame:
        """Add `capacity`, p_high, p_low and the gated `prediction`. A row that lacks a feature with a
        weight, or is of a site without a model, fails the job."""
        both = self.chosen.groupBy("site").agg(
            *[
                F.first(F.when(F.col("regime") == r, F.struct("intercept", "weights")), True).alias(r)
                for r in (HIGH, LOW)
            ]
        )
        models = both.join(self.capacities, "site").select(
            "site",
            "capacity",
            F.coalesce(HIGH, LOW).alias("_high"),
            F.coalesce(LOW, HIGH).alias("_low"),
        )
        width = 2 * 8 * (len(self.features) + 2)
        joined = _attach(rows, models, ["site"], width)
        missing = F.raise_error(F.concat(F.lit("no model or missing features for site "), F.col("site")))

        def predicted(model: str) -> Column:
            made = _applied(F.col(model), self.features)
            return F.when(made.isNotNull(), made).otherwise(missing.cast("double"))

        scored = joined.withColumns({"p_high": predicted("_high"), "p_low": predicted("_low")})
        made = gate("p_high", "p_low", F.col("capacity"), self.share)
        return scored.withColumn(PREDICTION, made).select(
            *[F.col(f"`{c}`") for c in rows.columns], "capacity", "p_high", "p_low", PREDICTION
        )


    def by_site(self) -> dict[str, LinearSite]:
        """The chosen models by name, as many as there are sites."""
        caps = {r.site: r.capacity for r in self.capacities.collect()}
        made = {site: LinearSite(cap, {}) for site, cap in caps.items()}
        for r in self.chosen.collect():
            made[r.site].regimes[r.regime] = r.asDict()
        return made


@dataclass
class LinearSite:
    """One site's capacity and, by regime, the chosen candidate with its score and weights."""

    capacity: float
    regimes: dict[str, dict]


def _attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], row_bytes: int) -> DataFrame:
    """Join a table of one row a key, broadcast only if its bytes are few."""
    table = written(table, "weights")
    units = table.count() * max(1, row_bytes // ROW_BYTES)
    return attach_per_key(rows, table, keys, spread_by=["time"], max_rows=units)


def _applied(model: Column, features: Sequence[str]) -> Column:
    """Intercept plus weights times features, in the order of `features`. NULL if a feature with a
    weight is missing."""
    made = model["intercept"]
    for i, c in enumerate(features):
        weight = F.get(model["weights"], F.lit(i))
        made = made + F.when(weight == 0, 0.0).otherwise(weight * F.col(f"`{c}`"))
    return made


def _check_whole(rows: DataFrame, features: Sequence[str]) -> None:
    """A column that some rows of a site have and others lack fails, with names."""
    counts = rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(features)],
    )
    partly = F.array_compact(
        F.array(
            *[
                F.when((F.col(f"_{i}") > 0) & (F.col(f"_{i}") < F.col("_n")), F.lit(c))
                for i, c in enumerate(features)
            ]
        )
    )
    found = counts.select("site", partly.alias("partly")).filter(F.size("partly") > 0).take(3)
    if found:
        where = "; ".join(f"{r.site}: {', '.join(r.partly)}" for r in found)
        raise ValueError(f"missing values in features of {where}")


def _check_regimes(counts: DataFrame, kinds: Mapping[str, str], settings, other_for_empty) -> None:
    """As for one site: a regime without rows fails unless the other may stand in, one with fewer
    rows than folds fails if there are candidates to choose from."""
    wide = counts.groupBy("site").agg(
        *[F.sum(F.when(F.col("regime") == r, F.col("n")).otherwise(0)).alias(r) for r in (HIGH, LOW)]
    )
    several = {
        r: [s for s, kind in kinds.items() if settings.n_draws(kind, r) > 1] for r in (HIGH, LOW)
    }
    few = F.lit(False)
    for r in (HIGH, LOW):
        short = (F.col(r) < settings.folds) & F.col("site").isin(several[r])
        few = few | ((F.col(r) > 0) & short if other_for_empty else (F.col(r) == 0) | short)
    few = few | ((F.col(HIGH) == 0) & (F.col(LOW) == 0))
    without = set(kinds) - {r.site for r in wide.select("site").collect()}  # no more than `kinds`
    if without:
        raise ValueError(f"no measured output to train on: {', '.join(sorted(without))}")
    found = wide.filter(few).take(3)
    if found:
        raise ValueError(f"too few rows to train on: {', '.join(f'{r.site} {r.asDict()}' for r in found)}")


def _products(ready: DataFrame, names: Sequence[str]) -> DataFrame:
    """(site, regime, fold, moments): sums of products of (1, features, label) about the means of
    the (site, regime); `ready` holds these means as an array."""
    width = len(names) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def passed_on() -> pd.DataFrame:
            keys = list(sums)
            made = pd.DataFrame(keys, columns=KEYS).loc[np.repeat(np.arange(len(keys)), width * width)]
            made["cell"] = np.tile(np.arange(width * width), len(keys))
            made["v"] = np.concatenate([m.ravel() for m in sums.values()])
            sums.clear()
            return made

        for batch in batches:
            rows = batch[list(names)].to_numpy(dtype=float)
            rows = np.hstack([np.ones((len(rows), 1)), rows])
            for key, at in batch.groupby(KEYS).indices.items():
                part = rows[at]
                sums[key] = sums.get(key, 0.0) + part.T @ part
            if len(sums) * width * width * 8 > HELD_BYTES:
                yield passed_on()
        if sums:
            yield passed_on()

    centred = [
        (F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) - F.get("means", F.lit(i))).alias(c)
        for i, c in enumerate(names)
    ]
    cells = ready.select(*KEYS, *centred).mapInPandas(
        partial, "site string, regime string, fold int, cell int, v double"
    )
    summed = cells.groupBy(*KEYS, "cell").agg(F.sum("v").alias("v"))
    # Of width squared cells a key.
    return summed.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda x: x["v"]).alias("moments")
    )


def _solutions(kinds: Mapping[str, str], settings: SearchSettings, width: int):
    """A function that solves all fits of the (site, regime) rows it is given."""
    drawn = {
        (kind, r): draw(settings.space(kind, r), settings.n_draws(kind, r), settings.seed)
        for kind in set(kinds.values())
        for r in (HIGH, LOW)
    }

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                folds = {
                    f["fold"]: (
                        np.array(f["moments"]).reshape(width, width),
                        np.array(f["low"]),
                        np.array(f["high"]),
                    )
                    for f in row.folds
                }
                candidates = drawn[kinds[row.site], row.regime]
                means = np.array(row.means)
                score = len(candidates) > 1 or row.n >= settings.folds
                for left_out in [ALL, *(range(settings.folds) if score else [])]:
                    kept = [m for f, m in folds.items() if f != left_out]
                    moments = sum(m[0] for m in kept)
                    # A feature with one value in these rows gets no weight.
                    low = np.min([m[1] for m in kept], axis=0)
                    live = np.max([m[2] for m in kept], axis=0) > low
                    on = np.append(np.flatnonzero(live) + 1, width - 1)
                    on = np.append(0, on)
                    part = moments[np.ix_(on, on)]
                    for k, d in enumerate(candidates):
                        w, start = np.zeros(width - 2), moments[0, -1] / moments[0, 0]
                        if live.any():
                            w[live], start = solve_linear(
                                part, kinds[row.site], d["alpha"], d.get("l1_ratio", 1.0)
                            )
                        # Back from the centred features and label.
                        intercept = start + means[-1] - w @ means[:-1]
                        out.append(
                            (row.site, row.regime, left_out, k, float(d["alpha"]))
                            + (float(d.get("l1_ratio", 1.0)), int(row.n), float(intercept), w.tolist())
                        )
            names = ["site", "regime", "fold", "candidate", "alpha", "l1_ratio", "n", "intercept", "weights"]
            yield pd.DataFrame(out, columns=names)

    return solved


SOLVED = (
    "site string, regime string, fold int, candidate int, alpha double, l1_ratio double, n bigint,"
    " intercept double, weights array<double>"
)


def fit_many(
    train: DataFrame,
    features: Sequence[str],
    capacities: DataFrame,
    kinds: Mapping[str, str],
    settings: SearchSettings | None = None,
    share: float = HIGH_SHARE,
    other_for_empty: bool = False,
    other_for_few: bool = False,
) -> ManyModels:
    """Fit both regimes of all sites. `train` holds `site`, `time`, the features and the label;
    `capacities` has one row a site and `kinds` names each site's linear model. A regime without rows
    (`other_for_empty`) or with fewer rows than folds (`other_for_few`) is served by the other one's
    model; else it fails, unless there is but one candidate for the few rows."""
    settings, features = settings or SearchSettings(), list(features)
    if not set(kinds.values()) <= set(LINEAR):
        raise ValueError(f"not linear models: {sorted(set(kinds.values()) - set(LINEAR))}")
    capacities = written(capacities.select("site", "capacity"), "capacities")
    names = [*features, LABEL]
    doubles = [F.col(f"`{c}`").cast("double").alias(c) for c in names]
    split = (
        attach_per_key(train.select("site", "time", *doubles), capacities, ["site"])
        .withColumn("regime", regime(LABEL, "capacity", share))
        .filter("regime is not null")
        .drop("capacity")
    )
    ready = written(contiguous_folds(split, ["site", "regime"], settings.folds), "training")
    _check_whole(ready, features)

    def each(f) -> Column:
        return F.array(*[f(F.coalesce(F.col(f"`{c}`"), F.lit(0.0))) for c in names])

    stats = written(
        ready.groupBy(*KEYS).agg(
            F.count(F.lit(1)).alias("n"),
            each(F.sum).alias("sums"),
            each(F.min).alias("low"),
            each(F.max).alias("high"),
        ),
        "fold-stats",
    )
    means = stats.groupBy("site", "regime").agg(
        F.sum("n").alias("n"),
        F.array(
            *[F.sum(F.get("sums", F.lit(i))) / F.sum("n") for i in range(len(names))]
        ).alias("means"),
    )
    if other_for_few:
        means = means.filter(F.col("n") >= settings.folds)
    means = written(means, "means")
    _check_regimes(means, kinds, settings, other_for_empty or other_for_few)
    fitted = _attach(ready, means.drop("n"), ["site", "regime"], 8 * len(names))
    products = _products(fitted.filter("means is not null"), names)
    inputs = (
        products.join(
            stats.select(*KEYS, F.slice("low", 1, len(features)).alias("low"), F.slice("high", 1, len(features)).alias("high")),
            KEYS,
        )
        .groupBy("site", "regime")
        .agg(F.collect_list(F.struct("fold", "moments", "low", "high")).alias("folds"))
        .join(means, ["site", "regime"])
    )
    fits = written(
        inputs.mapInPandas(_solutions(kinds, settings, len(names) + 1), SOLVED), "fits"
    )

    # All candidates at their left-out folds.
    models = fits.filter(F.col("fold") != ALL).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("candidate", "intercept", "weights"))).alias("models")
    )
    most = max((settings.n_draws(k, r) for k in set(kinds.values()) for r in (HIGH, LOW)), default=1)
    held_out = _attach(ready, models, KEYS, most * 8 * (len(names) + 2))
    errors = (
        held_out.filter("models is not null")
        .select(*KEYS, *[F.col(f"`{c}`") for c in names], F.explode("models").alias("model"))
        .select(
            *KEYS,
            F.col("model.candidate").alias("candidate"),
            F.abs(_applied(F.col("model"), features) - F.col(LABEL)).alias("off"),
        )
        .groupBy(*KEYS, "candidate")
        .agg(F.avg("off").alias("mae"))
        .groupBy("site", "regime", "candidate")
        .agg(F.avg("mae").alias("mae"))
    )
    tried = written(
        fits.filter(F.col("fold") == ALL).join(errors, ["site", "regime", "candidate"], "left"),
        "tried",
    )
    first = F.min(F.struct(F.coalesce("mae", F.lit(0.0)), "candidate"))["candidate"].alias("candidate")
    best = tried.groupBy("site", "regime").agg(first)
    chosen = written(tried.join(best, ["site", "regime", "candidate"]).drop("fold"), "chosen")
    return ManyModels(
        features,
        share,
        capacities,
        chosen,
        tried.select("site", "regime", "candidate", "alpha", "l1_ratio", "mae"),
    )
