"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, (list, tuple)):
        return [_cell(x) for x in v]
    return "nan" if isinstance(v, float) and v != v else repr(v) if isinstance(v, float) else str(v)


def same_rows(df, relation) -> None:
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    got = sorted(([_cell(v) for v in row] for row in df.select(*names).collect()), key=str)
    at = [list(relation.columns).index(n) for n in names]
    want = sorted(([_cell(row[i]) for i in at] for row in relation.fetchall()), key=str)
    assert got == want
