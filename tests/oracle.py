"""Compare a query with its SQL, as the driver does: columns by name, rows in any order."""

import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "~"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([_cell(x) for x in v])
    if hasattr(v, "item") and not isinstance(v, pd.Timestamp):
        v = v.item()
    if isinstance(v, float):
        return "~" if v != v else str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in df.itertuples(index=False))
