"""Rows of a Spark query and of its SQL in DuckDB, comparable."""

import glob
import os

import duckdb
import pandas as pd


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        if isinstance(v, float):
            return round(v, 6)
        return int(v) if hasattr(v, "dtype") and v.dtype.kind in "iu" else v

    return sorted(str([plain(v) for v in r]) for r in df.astype(object).itertuples(index=False, name=None))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c
