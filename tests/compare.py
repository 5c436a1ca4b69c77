"""Side-by-side run of a Spark query and its SQL counterpart in DuckDB."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _key(row):
    return tuple((v is not None, str(type(v).__name__ in ("str",)), v if isinstance(v, str) else 0.0 if v is None else
                  v.timestamp() if isinstance(v, datetime) else float(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


def difference(spark_df, con, text) -> str | None:
    """None when both results are equal, else a description."""
    left_cols, left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(text)
    right_cols, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} / {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, columns {left_cols}, first {bad[0]}"
    return None
