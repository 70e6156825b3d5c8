"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    assert glob.glob(f"{sf_dir}/*.parquet")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 5) + 0.0


def same(df, connection: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = connection.sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(df.columns)
    want = sorted(repr([plain(r[found.columns.index(c)]) for c in columns]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want
