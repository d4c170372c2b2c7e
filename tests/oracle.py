"""Compares a query with its DuckDB oracle, rows as a bag, floats to nine digits."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if hasattr(v, "__len__") and not isinstance(v, str | bytes | dict):
        return tuple(map(plain, v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def bag(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


def compare(spark, con, query, sql, sf_dir):
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    # A whole-number column with nulls is a float column in pandas.
    fix = lambda f: f.astype({c: "Float64" for c in f.columns if pd.api.types.is_numeric_dtype(f[c]) and not pd.api.types.is_bool_dtype(f[c])})
    assert bag(fix(ours)) == bag(fix(theirs))
