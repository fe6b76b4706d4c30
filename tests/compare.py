"""Run registered queries in Spark and their oracles in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    cells = frame[columns].astype(object).itertuples(index=False, name=None)
    return sorted((tuple(_cell(v) for v in row) for row in cells), key=repr)


def differences(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> list[str]:
    """Human-readable differences, empty if both frames hold the same rows."""
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} != {sorted(oracle_frame.columns)}"]
    left, right = rows(spark_frame), rows(oracle_frame)
    if len(left) != len(right):
        return [f"row count {len(left)} != {len(right)}"]
    return [f"{a} != {b}" for a, b in zip(left, right) if a != b]
