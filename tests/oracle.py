"""Compare a query with its SQL in DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def tables(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def assert_same(spark, query, sql: str, folder: str) -> pd.DataFrame:
    got, want = query(spark, folder).toPandas(), tables(folder).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = got[cols].sort_values(cols).reset_index(drop=True)
    b = want[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)
    return a
