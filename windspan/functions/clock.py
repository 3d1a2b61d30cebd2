"""Dates, hours and zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_parts(time: Column | str) -> dict[str, Column]:
    t = _c(time)
    return {
        "year": F.year(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "hour": F.hour(t),
    }


def target_parts(time: Column | str) -> dict[str, Column]:
    return {"date": F.to_date(_c(time)), "hour": F.hour(_c(time))}


def wall_clock(instant: Column | str, tz: Column | str) -> Column:
    """Drop the zone of an instant, keeping the clock reading at `tz`."""
    zone = F.lit(tz) if isinstance(tz, str) else tz
    return F.convert_timezone(F.current_timezone(), zone, _c(instant).cast("timestamp_ntz"))


def parse_time(text: Column | str) -> Column:
    return _c(text).cast("timestamp_ntz")


def compact_date(d: Column | str) -> Column:
    return F.date_format(_c(d), "yyyyMMdd")


def date_between(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Inclusive range test for a yyyyMMdd text; a text that is no date is outside."""
    day = F.try_to_timestamp(_c(text), F.lit("yyyyMMdd")).cast("date")
    low = F.lit(start).cast("date") if isinstance(start, str) else start
    high = F.lit(end).cast("date") if isinstance(end, str) else end
    return day.between(low, high)


def epoch_seconds(time: Column | str) -> Column:
    """Seconds since 1970 of a zone-less or zoned time, by its clock reading."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", origin, _c(time).cast("timestamp_ntz"))
