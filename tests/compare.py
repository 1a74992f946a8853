"""Rows of a Spark query against those of its SQL twin."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd


def canon(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    return v


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(canon(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
