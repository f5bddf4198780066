"""Spark rows against DuckDB rows of the same query."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    return value


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def assert_same(df, con, sql):
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert have == want
