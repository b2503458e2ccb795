"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares names, types and sorted rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows_of(spark_rows, columns):
    return sorted((tuple(_plain(r[c]) for c in columns) for r in spark_rows), key=repr)


def _plain(x):
    return round(x, 9) if isinstance(x, float) else x


def differences(spark, sf, run, sql, con=None):
    con = con or connect(sf)
    df = run(spark, sf)
    got = df.collect()
    ran = con.execute(sql)
    names = [d[0] for d in ran.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = sorted((tuple(_plain(v) for v in r) for r in ran.fetchall()), key=repr)
    mine = rows_of(got, names)
    if len(mine) != len(want):
        return f"{len(mine)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(mine, want, strict=True) if a != b]
    return f"{len(bad)} of {len(want)} rows differ, such as {bad[0]}"[:600] if bad else ""
