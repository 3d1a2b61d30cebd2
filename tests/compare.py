"""Run a query and its SQL side by side and compare rows, whatever their order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]")
        elif pd.api.types.is_integer_dtype(df[c]) and df[c].isna().any():
            df[c] = df[c].astype("float64")  # as Spark's own conversion has it
        elif df[c].isna().all():
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), ignore_index=True)


def assert_same(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(
        normal(spark_df), normal(sql_df), check_dtype=True, check_exact=True
    )
