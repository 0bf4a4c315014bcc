"""Compares a query with its SQL on DuckDB, as the driver does."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "∅"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False, name=None))
