"""Compares queries with their SQL in DuckDB: columns by name, rows as sorted text."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def text(value) -> str:
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.5f}".replace("-0.00000", "0.00000")
    return str(value)


def difference(df, con, sql: str) -> str:
    """'' if equal, else what differs."""
    want = con.execute(sql)
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    expected = sorted(tuple(text(r[i]) for i in order) for r in want.fetchall())
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} against {names}"
    got = sorted(tuple(text(x) for x in r) for r in df.select(*names).collect())
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    bad = [(a, b) for a, b in zip(got, expected, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
