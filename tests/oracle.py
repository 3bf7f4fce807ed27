"""Holds registered queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def same(df, con, sql: str) -> None:
    result = con.sql(sql)
    names, theirs = result.columns, result.fetchall()
    ours = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    a, b = [df.columns.index(c) for c in sorted(names)], [names.index(c) for c in sorted(names)]
    assert sorted(tuple(_plain(r[i]) for i in a) for r in ours) == sorted(tuple(_plain(r[i]) for i in b) for r in theirs)
