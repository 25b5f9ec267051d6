"""Compare a Spark query with its DuckDB oracle the way the driver does:
row count, column names, and an order-insensitive hash of the values."""

from __future__ import annotations

import decimal
import hashlib
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def row_hash(rows: list[tuple]) -> str:
    keys = sorted(repr(tuple(_norm(x) for x in r)) for r in rows)
    return hashlib.sha256("\n".join(keys).encode()).hexdigest()


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> dict:
    sdf = query(spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = [tuple(r[c] for c in cols) for r in sdf.collect()]
    rel = con.execute(sql)
    dcols_raw = [d[0] for d in rel.description]
    drows_raw = rel.fetchall()
    dcols = sorted(dcols_raw)
    idx = [dcols_raw.index(c) for c in dcols]
    drows = [tuple(r[i] for i in idx) for r in drows_raw]
    return {
        "name": name,
        "rows_spark": len(srows), "rows_oracle": len(drows),
        "cols_match": cols == dcols, "cols_spark": cols, "cols_oracle": dcols,
        "hash_match": cols == dcols and row_hash(srows) == row_hash(drows),
    }
