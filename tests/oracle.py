"""Runs a query and its SQL side by side, the way the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def _cell(x):
    if x is None or x is pd.NaT:
        return (0, "")
    if isinstance(x, float):
        return (0, "") if math.isnan(x) else (1, f"{x + 0.0:.9g}")
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return (2, str(bool(x)))
    if isinstance(x, int) or type(x).__name__.startswith("int"):
        return (1, f"{float(x):.9g}") if abs(x) < 2**53 else (3, str(int(x)))
    return (3, str(x))


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in data)


def difference(df, con, sql: str) -> str:
    """What differs, in words; nothing if all is equal."""
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.sql(sql)
    theirs = rows(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return f"columns {sorted(df.columns)} against {sorted(found.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    odd = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(odd)} rows differ, first {odd[0]}" if odd else ""
