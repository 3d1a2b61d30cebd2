"""Two models per site, one for high and one for low output, and the gate between them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windspan.functions.output import HIGH, HIGH_SHARE, LOW, gate, regime
from windspan.operators.models import LABEL, PREDICTION, assemble
from windspan.operators.rows import contiguous_folds
from windspan.operators.search import (
    Chosen,
    SearchSettings,
    check_kind,
    regime_rows,
    search,
    usable_regimes,
)
from windspan.session import written


@dataclass
class DualModel:
    capacity: float
    share: float
    features: list[str]
    counts: dict[str, int]
    high: Chosen
    low: Chosen

    def score(self, rows: DataFrame) -> DataFrame:
        """Add p_high, p_low and the gated `prediction`."""
        vectors = assemble(rows, self.features)
        both = (
            self.high.model.transform(vectors)
            .withColumnRenamed(PREDICTION, "p_high")
        )
        both = self.low.model.transform(both).withColumnRenamed(PREDICTION, "p_low")
        return both.select(
            *rows.columns,
            "p_high",
            "p_low",
            gate("p_high", "p_low", F.lit(self.capacity), self.share).alias(PREDICTION),
        )


def fit_dual(
    train: DataFrame,
    features: Sequence[str],
    capacity: float,
    kind: str,
    settings: SearchSettings | None = None,
    share: float = HIGH_SHARE,
    other_for_empty: bool = False,
) -> DualModel:
    """Fit one site's two models on rows with `site`, `time`, the features and the label.

    Rows without a label belong to neither regime. A regime without rows, or with fewer rows
    than folds where there is more than one candidate, fails the fit; with `other_for_empty` the
    other regime's model serves one without rows.
    """
    settings = settings or SearchSettings()
    check_kind(kind)
    if capacity is None:
        raise ValueError("no measured output to train on")
    split = train.withColumn("regime", regime(LABEL, F.lit(capacity), share)).filter(
        F.col("regime").isNotNull()
    )
    # Searched many times over, so stored once: later passes scan a compact table.
    ready = written(
        contiguous_folds(
            split.select("site", "time", LABEL, "regime", *[F.col(f"`{c}`") for c in features]),
            ["site", "regime"],
            settings.folds,
        ),
        "training",
    )
    counts = regime_rows(ready)
    names = sorted(str(r.site) for r in ready.select("site").distinct().take(3))
    usable = usable_regimes(
        counts, kind, settings, f" of {', '.join(names)}" if names else "", other_for_empty
    )
    found = search(ready, features, kind, usable, settings)
    high, low = found.get(HIGH), found.get(LOW)
    return DualModel(capacity, share, list(features), counts, high or low, low or high)
