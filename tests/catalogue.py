"""Holds queries against their SQL in DuckDB, over the smallest tables."""

import os
import re
from pathlib import Path

import duckdb
import pandas as pd


def connection(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{os.fspath(f)}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(int(v))
    if isinstance(v, float) or type(v).__name__ in ("Decimal", "float32", "float64"):
        return f"{float(v):.6g}"
    return str(v).replace("+00:00", "").removesuffix(" 00:00:00")


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def agrees(spark, folder, query, sql):
    got, want = query(spark, folder).toPandas(), connection(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    left, right = rows(got), rows(want)
    assert sorted(map(numbers, left)) == sorted(map(numbers, right))
    return len(left)


def numbers(row):
    """Numbers alike, whatever their types."""
    return tuple(f"{float(x):.6g}" if re.fullmatch(r"-?[0-9]{1,15}(\.[0-9]+)?", x) else x for x in row)
