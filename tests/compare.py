"""Comparing a query's rows with DuckDB's, as multisets, types included."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connection(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def assert_same(df, con, sql):
    columns, relation = sorted(df.columns), con.sql(sql)
    assert sorted(relation.columns) == columns
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    at = [relation.columns.index(c) for c in columns]
    want = _sorted(tuple(_value(r[i]) for i in at) for r in relation.fetchall())
    got = _sorted(tuple(_value(r[c]) for c in columns) for r in df.collect())
    assert got == want
