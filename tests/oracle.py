"""Compare a query with its SQL: columns by name, rows in any order."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def compare(spark, query, sql, sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    r = c.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(x[n]) for n in names) for x in df.collect())
    theirs = sorted(tuple(plain(dict(zip(r.columns, x))[n]) for n in names) for x in r.fetchall())
    assert mine == theirs
    return len(mine)
