"""Compares a registered query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def _value(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return None if math.isnan(float(x)) else round(float(x), 6)
    return str(x)


def rows(frame):
    cols = sorted(frame.columns)
    out = [tuple(_value(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def compare(spark, con, sf_dir, query, sql):
    mine, theirs = rows(query(spark, sf_dir).toPandas()), rows(con.execute(sql).df())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
