"""Compares a query with its SQL on the tables of a folder."""

import decimal
import glob
import math
import os

import duckdb


def connected(folder):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())


def rows_by_sql(connection, sql, columns):
    r = connection.sql(sql)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    return sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())
