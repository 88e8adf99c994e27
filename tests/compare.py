"""A registered query against its SQL oracle in DuckDB."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int,)):
        return float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "is_finite"):  # a decimal
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return rows_of([c[0] for c in found.description], found.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])
