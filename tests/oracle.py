"""Compares a query's rows with the rows of its SQL in DuckDB over the same files."""

from __future__ import annotations

import math
import os
from glob import glob

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "as_tuple") else v


def rows_of_sql(directory: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in glob(f"{directory}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    result = con.sql(sql)
    return list(result.columns), result.fetchall()


def assert_same(df, directory: str, sql: str) -> None:
    columns = sorted(df.columns)
    names, want = rows_of_sql(directory, sql)
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(x[i]) for i in order)) for x in want)
