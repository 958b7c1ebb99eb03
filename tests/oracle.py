"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.6g}")
    if isinstance(value, int):
        return float(f"{value:.15g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value) if not isinstance(value, str) else value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences, empty when equal."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    expected = rows_of(names, cursor.fetchall())
    found = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if expected == found:
        return []
    only_spark, only_sql = found - expected, expected - found
    return [
        f"rows {sum(found.values())} vs {sum(expected.values())}",
        f"only spark: {list(only_spark)[:3]}",
        f"only sql: {list(only_sql)[:3]}",
    ]
