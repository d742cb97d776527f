"""Runs a query and its SQL on the same tables and compares all rows."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def database(folder: str = DATA):
    db = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if type(v).__name__ in ("Decimal", "date", "datetime") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql, db, folder: str = DATA):
    df = query(spark, folder)
    r = db.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(r.columns, r.fetchall())
