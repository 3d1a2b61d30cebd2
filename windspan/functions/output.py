"""Columns of the output side: regime, gate, uplift, errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, LOW = "high", "low"
# Share of capacity that makes an hour a high-output hour, and its uplift.
HIGH_SHARE = 0.1
UPLIFT = 1.05


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def threshold(capacity: Column | str, share: float = HIGH_SHARE) -> Column:
    return F.lit(share) * _c(capacity)


def regime(y: Column | str, capacity: Column | str, share: float = HIGH_SHARE) -> Column:
    """'high', 'low', or NULL where y is missing."""
    limit = threshold(capacity, share)
    return F.when(_c(y) >= limit, HIGH).when(_c(y) < limit, LOW)


def gate(high: Column | str, low: Column | str, capacity: Column | str, share: float = HIGH_SHARE):
    """The high model's value where it says high, else the low model's."""
    return F.when(_c(high) >= threshold(capacity, share), _c(high)).otherwise(_c(low))


def uplift_clip(p: Column | str, capacity: Column | str, share: float = HIGH_SHARE) -> Column:
    """Raise high values, then keep all within 0 and capacity; a missing value stays missing."""
    p, cap = _c(p), _c(capacity)
    raised = F.when(p >= threshold(cap, share), p * UPLIFT).otherwise(p)
    return F.when(
        p.isNotNull() & cap.isNotNull(), F.least(F.greatest(raised, F.lit(0.0)), cap)
    )


def weighted_error(y: Column | str, p: Column | str, capacity: Column | str) -> Column:
    """Absolute error, doubled where the measured value is high. Averaged over rows, this is
    the weighted loss: the mean divides by the row count, not by the weights."""
    weight = F.when(_c(y) >= threshold(capacity), 2.0).otherwise(1.0)
    return weight * F.abs(_c(y) - _c(p))
