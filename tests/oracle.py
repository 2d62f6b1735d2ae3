"""Runs a query's SQL in DuckDB and compares rows regardless of order."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def key(row: tuple) -> tuple:
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def rows(columns: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(v[i] for i in order) for v in values), key=lambda r: str(key(r)))


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    wanted = rows(names, result.fetchall())
    assert len(found) == len(wanted)
    assert found == wanted
