"""Spark results against DuckDB's over the same Parquet files."""

from pathlib import Path

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connection(sf_dir=SF):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
        return str(list(v))
    if pd.isna(v):
        return None
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else str(round(v, 6))
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False))
