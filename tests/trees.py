"""Small snapshot trees, written file by file as a weather service would."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from windspan.plans.table_views import SITES

COLUMNS = ["ta_1p5m", "rh_1p5m", "pmsl", "uws_10m", "vws_10m", "fvmin_50m", "fvmax_50m"]


def hour_cells(at: pd.Timestamp, per_site: int = 2) -> pd.DataFrame:
    """A few cells in each site's box and one far away; each hour differs."""
    rng = np.random.default_rng(int(at.timestamp()) // 3600)
    parts = []
    for s in SITES:
        parts.append(
            pd.DataFrame(
                {
                    "latitude": s.lat + rng.uniform(-0.01, 0.01, per_site),
                    "longitude": s.lon + rng.uniform(-0.01, 0.01, per_site),
                }
            )
        )
    parts.append(pd.DataFrame({"latitude": [10.0], "longitude": [20.0]}))
    df = pd.concat(parts, ignore_index=True)
    n = len(df)
    df["ta_1p5m"] = rng.uniform(270, 300, n)
    df["rh_1p5m"] = rng.uniform(20, 100, n)
    df["pmsl"] = rng.uniform(990, 1030, n)
    df["uws_10m"] = rng.uniform(-10, 10, n)
    df["vws_10m"] = rng.uniform(-10, 10, n)
    df["fvmin_50m"] = rng.uniform(0, 10, n)
    df["fvmax_50m"] = df["fvmin_50m"] + rng.uniform(0, 10, n)
    df["level"] = np.arange(n)
    return df


def put(root: Path, at: pd.Timestamp, cells: pd.DataFrame, folder: str | None = None) -> Path:
    path = root / (folder or f"{at:%Y%m%d}") / f"{at:%Y-%m-%d_%H_%M_%S}.parquet"
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.Table.from_pandas(cells, preserve_index=False), path)
    return path


def tree(root: Path, start: str, end: str, skip=()) -> list[pd.Timestamp]:
    hours = [h for h in pd.date_range(start, end, freq="h") if str(h) not in skip]
    for at in hours:
        put(root, at, hour_cells(at))
    return hours


def site_maxima(hours, sites=SITES) -> pd.DataFrame:
    """What the series must hold, by pandas."""
    rows = []
    for at in hours:
        cells = hour_cells(at)
        for s in sites:
            south, north, west, east = s.box
            box = cells[cells.latitude.between(south, north) & cells.longitude.between(west, east)]
            floats = box.drop(columns="level").astype("float32").max()
            rows.append({"site": s.site, "time": at, **floats, "level": box.level.max()})
    return pd.DataFrame(rows)
