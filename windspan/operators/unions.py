"""Vertical concatenation, strict and lenient."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def concat_strict(frames: Sequence[DataFrame]) -> DataFrame:
    """Same names, order and types, or an error; Spark alone would widen and reorder."""
    first, *rest = frames
    for other in rest:
        if other.dtypes != first.dtypes:
            raise ValueError(f"schemas differ: {first.dtypes} / {other.dtypes}")
    return reduce(DataFrame.union, rest, first)


def concat_fill(frames: Sequence[DataFrame]) -> DataFrame:
    """All columns of all frames; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
