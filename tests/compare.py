"""Rows of a Spark query against rows of its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def database(directory=DATA):
    db = duckdb.connect()
    for f in sorted(os.listdir(directory)):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{directory}/{f}'")
    return db


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        v = round(v, 6)
        return int(v) if v.is_integer() else v
    if isinstance(v, bool):
        return int(v)
    return str(v) if not isinstance(v, (int, str)) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def assert_equal(spark_df, db, text):
    mine, theirs = spark_df.toPandas(), db.execute(text).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b) if x != y][:3] == [y for x, y in zip(a, b) if x != y][:3]
