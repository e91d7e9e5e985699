"""Comparing a Spark query with its SQL on the same files."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(v)
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(str([plain(v) for v in r]) for r in df.astype(object).itertuples(index=False, name=None))


def same(spark, query, sql: str, folder: str) -> None:
    got = query(spark, folder).toPandas()
    want = connect(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b
