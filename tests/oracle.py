"""Rows of a query against rows of its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def compare(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    names, rows = found.columns, found.fetchall()
    cols = sorted(df.columns)
    assert cols == sorted(names)
    mine = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(value(r[names.index(c)]) for c in cols) for r in rows)
    assert mine == theirs
