"""Run a query and its SQL on the same tables and compare their rows."""

import math
import os

import duckdb

DATA = os.environ.get("KEYQUARRY_DATA", "/root/testdata")


def connect(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}" if os.path.isfile(f"{sf_dir}/{name}") else f"{sf_dir}/{name}/*.parquet"
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(df.columns), sorted(names), got, rows_of(names, cur.fetchall())
