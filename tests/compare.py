"""Holds a Spark query against its SQL in DuckDB, without regard to row order."""

import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.8g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in df.collect())


def expected(con, sql):
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(found.columns), sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())
