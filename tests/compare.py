"""Spark rows against DuckDB rows, without regard to order."""

import math
import os
from decimal import Decimal

import duckdb
import pandas as pd


def connect(d):
    db = duckdb.connect()
    for f in sorted(os.listdir(d)):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    return db


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if str(type(v)).find("bool") >= 0:
        return str(bool(v))
    if isinstance(v, (int, float, Decimal)) or hasattr(v, "dtype"):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows_of(df):
    return sorted(tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(spark_df, duck_df):
    assert sorted(spark_df.columns) == sorted(duck_df.columns)
    a, b = rows_of(spark_df), rows_of(duck_df)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, wrong[:3]
