"""Run a registered query and its SQL on the same tables and compare all rows."""

import math
from datetime import datetime
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def assert_same(df, sf_dir, sql):
    names, expected = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    want = rows_of(names, expected)
    assert len(got) == len(want)
    assert got == want
