"""Row and column selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windspan.sites import Site

# Terms of the scan's filter; near boxes are merged until there are no more.
BOX_TERMS = 64

# Columns a target file may carry that are of no use, and those of the target
# that must not become features.
TARGET_EXTRAS = ("구분", "시간", "energy_mwh", "plant_name", "period_hours")
JOIN_LEFTOVERS = ("end_datetime", "filename", "date", "hour")
NOT_FEATURES = ("site", "time", "energy_kwh")
# The types that take part in a series.
NUMERIC = (T.DoubleType, T.FloatType, T.LongType)


def box_text(box: tuple[float, float, float, float], lat="latitude", lon="longitude") -> str:
    south, north, west, east = (f"{float(x)!r}D" for x in box)
    return f"({lat} between {south} and {north} and {lon} between {west} and {east})"


def in_box(box: tuple[float, float, float, float], lat="latitude", lon="longitude") -> Column:
    """Inside or on the edge of (lat_min, lat_max, lon_min, lon_max)."""
    return F.expr(box_text(box, lat, lon))


def merged_boxes(boxes: Sequence[tuple], terms: int = BOX_TERMS) -> list[tuple]:
    """At most `terms` boxes that hold all of `boxes`: parted at the widest gap, along either
    axis, as often as there are terms, so that none is drawn round boxes far from one another."""

    def widest_gap(group: list[tuple]) -> tuple[float, list[tuple], list[tuple]]:
        best = (-1.0, group, [])
        for low in (0, 2):
            ordered = sorted(group, key=lambda b: b[low])
            reach = ordered[0][low + 1]
            for i, box in enumerate(ordered[1:], 1):
                if box[low] - reach > best[0]:
                    best = (box[low] - reach, ordered[:i], ordered[i:])
                reach = max(reach, box[low + 1])
        if not best[2] and len(group) > 1:  # all overlap
            return (-1.0, group[: len(group) // 2], group[len(group) // 2 :])
        return best

    parts = [widest_gap(list(boxes))]
    while len(parts) < min(terms, len(boxes)):
        first = max((p for p in parts if p[2]), key=lambda p: p[0])
        parts.remove(first)
        parts += [widest_gap(first[1]), widest_gap(first[2])]
    groups = [one + other for _, one, other in parts]
    return [
        (min(b[0] for b in g), max(b[1] for b in g), min(b[2] for b in g), max(b[3] for b in g))
        for g in groups
    ]


def near_any_site(sites: Sequence[Site], lat="latitude", lon="longitude") -> Column:
    """A literal test that reaches the Parquet scan and drops row groups far from all sites."""
    boxes = merged_boxes([s.box for s in sites])
    return F.expr(" or ".join(box_text(b, lat, lon) for b in boxes))


def numeric_columns(df: DataFrame) -> list[str]:
    """Double, float and 64-bit integer columns; all other types are left out."""
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def numeric_projection(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Numeric columns with doubles narrowed to float, after the `keep` columns."""
    keep = list(keep)
    cols = [f"`{c}`" for c in keep]
    for field in df.schema:
        name = f"`{field.name}`"
        if field.name in keep or not isinstance(field.dataType, NUMERIC):
            continue
        wide = isinstance(field.dataType, T.DoubleType)
        cols.append(f"cast({name} as float) as {name}" if wide else name)
    return df.selectExpr(*cols)


def exclude_times(df: DataFrame, excluded: dict[str, str], key="site", time="time") -> DataFrame:
    """Drop one named hour per site. Rows without a time stay."""
    for name, at in excluded.items():
        hit = F.col(key).eqNullSafe(F.lit(name)) & F.col(time).eqNullSafe(
            F.lit(at).cast("timestamp_ntz")
        )
        df = df.filter(~hit)
    return df


def drop_incomplete(df: DataFrame, optional: Iterable[str] = ("energy_kwh",)) -> DataFrame:
    """Drop rows missing (NULL or NaN) any column but the optional ones."""
    optional = set(optional)
    return df.dropna(subset=[c for c in df.columns if c not in optional])


def feature_columns(df: DataFrame, leave_out: Iterable[str] = NOT_FEATURES) -> list[str]:
    leave_out = set(leave_out)
    return [c for c in df.columns if c not in leave_out]


def split_rows(df: DataFrame, train_when: str, test_when: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.expr(train_when)), df.filter(F.expr(test_when))
