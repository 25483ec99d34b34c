"""Comparing a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return f"{float(value):.6g}" if isinstance(value, float) else str(value)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sql, sf_dir=SF, **tables):
    """(rows, columns) of the SQL over a folder's tables; tables given by name (as pandas frames) come first."""
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    for path in Path(sf_dir).glob("*.parquet"):
        if path.stem not in tables:
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return found.fetchall(), [c[0] for c in found.description]


def assert_same(df, sql, sf_dir=SF, **tables):
    rows, columns = oracle(sql, sf_dir, **tables)
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.collect(), df.columns) == normal(rows, columns)
