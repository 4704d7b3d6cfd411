"""Compares a registered query with its SQL in DuckDB, column by column by name."""

import datetime
import math
import os

import duckdb

from tallyleaf.sources.fixtures import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(x):
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, dict):
        return str(sorted((value(k), value(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return str([value(y) for y in x])
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return "None" if x is None else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted([value(r[k]) for k in order] for r in data)


def duck(sql, data=DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    out = c.execute(sql)
    return rows([d[0] for d in out.description], out.fetchall())


def same(spark, query, sql, data=DATA):
    df = query(spark, data)
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    want_names, want = duck(sql, data)
    assert names == want_names, (names, want_names)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:2]
    return len(got)
