"""Compares a Spark result with DuckDB's, whatever the order of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def oracle(sf: str, sql: str) -> pd.DataFrame:
    """Rows of ``sql`` over the tables in a folder."""
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con.execute(sql).fetchdf()


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted texts; columns by name."""

    def norm(v: object) -> str:
        if v is None or v is pd.NA or isinstance(v, (float, np.floating)) and math.isnan(v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 9))
        return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)

    return sorted(tuple(norm(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
