"""Row-for-row comparison of a Spark result with DuckDB's answer to the check SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def ordered(columns, rows):
    index = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [tuple(canonical(row[i]) for i in index) for row in rows]
    return sorted(columns), sorted(named, key=repr)


def differences(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    answer = con.execute(sql)
    expected_columns = [d[0] for d in answer.description]
    expected = ordered(expected_columns, answer.fetchall())
    got = ordered(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    if len(got[1]) != len(expected[1]):
        return f"{len(got[1])} rows != {len(expected[1])}"
    wrong = [(g, e) for g, e in zip(got[1], expected[1]) if g != e]
    if wrong:
        return f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0][0]} != {wrong[0][1]}"
    types = [type(v).__name__ for v in got[1][0]] if got[1] else []
    theirs = [type(v).__name__ for v in expected[1][0]] if expected[1] else []
    if types != theirs:
        return f"types {types} != {theirs}"
    return None
