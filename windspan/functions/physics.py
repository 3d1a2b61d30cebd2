"""Derived weather features, as SQL text.

Each function takes columns or expressions as text and returns text, so they nest and go
straight into `selectExpr` or `expr`. Inputs may be float; everything is computed in double.
A zero divisor gives NULL: ANSI mode would fail the job, and an infinite feature is of no use
to any model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Magnus formula, dry-air gas constant, freezing point.
FREEZING_K = "273.15d"
MAGNUS_BASE, MAGNUS_A, MAGNUS_B = "6.112d", "17.67d", "243.5d"
VAPOUR_FACTOR = "216.7d"
DRY_AIR_R = "287.05d"


def _d(text: str) -> str:
    return f"cast({text} as double)"


def absolute_humidity(temp_k: str, rh: str) -> str:
    t = _d(temp_k)
    celsius = f"({t} - {FREEZING_K})"
    saturation = (
        f"({MAGNUS_BASE} * exp(try_divide({MAGNUS_A} * {celsius}, {celsius} + {MAGNUS_B})))"
    )
    return f"try_divide({VAPOUR_FACTOR} * ({_d(rh)} * {saturation} / 100), {t})"


def rotor_area(radius: str) -> str:
    return f"(pi() * {_d(radius)} * {_d(radius)})"


def magnitude(a: str, b: str) -> str:
    x, y = _d(a), _d(b)
    return f"sqrt({x} * {x} + {y} * {y})"


def air_density(pressure_hpa: str, temp_k: str) -> str:
    return f"try_divide({_d(pressure_hpa)} * 100, {DRY_AIR_R} * {_d(temp_k)})"


def bearing(y: str, x: str) -> str:
    """Angle of (x, y) in degrees, 0 up to but excluding 360."""
    return f"((degrees(atan2({_d(y)}, {_d(x)})) + 360) % 360)"


def turbulence_intensity(high: str, low: str, speed: str) -> str:
    return f"(({_d(high)} - {_d(low)}) / ({_d(speed)} + 0.1d))"


def wind_energy(density: str, area: str, speed: str) -> str:
    v = _d(speed)
    return f"(0.5d * {_d(density)} * {_d(area)} * ({v} * {v} * {v}) / 1000 / 3600)"


# The names of the derived features. Each level uses the names of those before.
WIND = {
    "storm_speed": magnitude("fvmax_50m", "fvmin_50m"),
    "wind_speed": magnitude("uws_10m", "vws_10m"),
}
WIND_SQUARED = {"wind_speed_squared": "wind_speed * wind_speed"}
DIRECTION = {
    "wind_direction": bearing("vws_10m", "uws_10m"),
    "storm_direction": bearing("fvmin_50m", "fvmax_50m"),
}
DIRECTION_MIX = {
    "wind_direction_diff": "abs(wind_direction - storm_direction)",
    "wind_speed_direction_interaction": "wind_speed * cos(radians(wind_direction))",
}
CALENDAR = {
    "year": "year({time})",
    "month": "month({time})",
    "day": "day({time})",
    "hour": "hour({time})",
}


def _level(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return df.selectExpr(*kept, *[f"{sql} as {name}" for name, sql in columns.items()])


def wind_features(df: DataFrame) -> DataFrame:
    return _level(_level(df, WIND), WIND_SQUARED)


def direction_features(df: DataFrame) -> DataFrame:
    """Needs `wind_speed`."""
    return _level(_level(df, DIRECTION), DIRECTION_MIX)


def derived_features(df: DataFrame, radius: str = "turbine_rad", time: str = "time") -> DataFrame:
    """All derived columns; `radius` is consumed."""
    air = {
        "absolute_humidity": absolute_humidity("ta_1p5m", "rh_1p5m"),
        "turbine_area": rotor_area(radius),
        "air_density": air_density("pmsl", "ta_1p5m"),
    }
    last = {
        "turbulence_intensity": turbulence_intensity("fvmax_50m", "fvmin_50m", "wind_speed"),
        "wind_energy": wind_energy("air_density", "turbine_area", "wind_speed"),
        **{name: sql.format(time=time) for name, sql in CALENDAR.items()},
    }
    first = _level(_level(df, {**air, **WIND, **DIRECTION}), {**WIND_SQUARED, **DIRECTION_MIX})
    return _level(first, last).drop(radius)
