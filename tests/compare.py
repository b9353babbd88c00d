"""Comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal, float)):
        f = float(x)
        return "nan" if math.isnan(f) else round(f, 6) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return dt.datetime(x.year, x.month, x.day).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    return x


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both results are equal whatever their order."""
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {[x for x in got if x not in set(want)][:2]} and {[x for x in want if x not in set(got)][:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""
