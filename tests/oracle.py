"""Runs a query's SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    r = con.execute(sql)
    return [c[0] for c in r.description], r.fetchall()


def compare(df, sf_dir: str, sql: str) -> None:
    names, want = sql_rows(sf_dir, sql)
    order = sorted(names)
    assert sorted(df.columns) == order
    got = [tuple(r[c] for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got, want = sorted(got, key=key), sorted((tuple(r[i] for i in at) for r in want), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w
