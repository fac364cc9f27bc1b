"""A query's rows against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return int(v) if isinstance(v, bool) else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql):
    r = con.execute(sql)
    want_names, want = [x[0] for x in r.description], r.fetchall()
    got = [tuple(x) for x in df.collect()]
    assert sorted(df.columns) == sorted(want_names)
    assert rows(df.columns, got) == rows(want_names, want)
