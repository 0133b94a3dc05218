"""A Spark query and its SQL twin, compared as sorted rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def assert_same(spark, sf: str, query, sql: str) -> None:
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    mine, columns = df.collect(), sorted(df.columns)
    told = db.sql(sql)
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    left = sorted(tuple(str(_plain(r[c])) for c in columns) for r in mine)
    right = sorted(tuple(str(_plain(r[i])) for i in at) for r in told.fetchall())
    assert left == right
