"""Run a registered query in Spark and its oracle SQL in DuckDB and compare.

Mirrors the driver's check: row count, column names, and an order-insensitive
hash of the values (columns sorted by name, rows sorted).
"""

from __future__ import annotations

import hashlib
import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple("" if x is None else x for x in r))


def value_hash(df: pd.DataFrame) -> str:
    return hashlib.sha1(repr(canonical(df)).encode()).hexdigest()


def compare(spark_df, con, sql: str) -> dict:
    a = spark_df.toPandas()
    b = con.execute(sql).df()
    res = {"rows": (len(a), len(b)), "cols_equal": sorted(a.columns) == sorted(b.columns)}
    if not res["cols_equal"]:
        res["cols"] = (sorted(a.columns), sorted(b.columns))
        res["match"] = False
        return res
    ca, cb = canonical(a), canonical(b)
    res["match"] = ca == cb
    if not res["match"]:
        diff = [(x, y) for x, y in zip(ca, cb) if x != y][:3]
        res["diff"] = diff
    return res
