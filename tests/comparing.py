"""Run a registered query on Spark and its SQL on DuckDB and compare rows."""

from __future__ import annotations

import datetime
import math

import duckdb
import numpy as np
import pandas as pd

from foliospark.plans.rendered import TABLES

FOLDER = "/root/testdata/sf0.001"


def connect(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, float, np.integer, np.floating)):
        number = float(value)
        return None if math.isnan(number) else number
    if isinstance(value, (datetime.datetime, pd.Timestamp)):
        return str(pd.Timestamp(value))
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in ordered.itertuples(index=False)), key=repr)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} and {sorted(right.columns)}"
    a, b = rows(left), rows(right)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first: {wrong[0]}"[:2000]
    return None
