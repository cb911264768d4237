"""Runs a query and its SQL side by side."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb


def same(query, sql: str, spark, data: str) -> None:
    got = query(spark, data)
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f if os.path.isfile(f) else f'{f}/*.parquet'}'")
    want = con.execute(sql).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
