"""Rows of a Spark query and of its SQL in DuckDB, in a form that compares."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def normal(value):
    return round(value, 9) if isinstance(value, float) else value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=str)


def sql_rows(con, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    names = sorted(columns)
    return names, sorted((tuple(normal(dict(zip(columns, r, strict=True))[n]) for n in names) for r in found.fetchall()), key=str)
