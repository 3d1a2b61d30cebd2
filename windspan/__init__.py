"""Site forecasting on Spark: gridded hourly weather in, hourly site output out."""

from windspan.sites import DEFAULT_SITES, Site

__all__ = ["DEFAULT_SITES", "Site"]
