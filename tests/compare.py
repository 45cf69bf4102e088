"""Compare a query with its SQL: same columns, same rows, in any order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(spark_df, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if equal, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} instead of {sorted(names)}"
    mine, theirs = rows_of(spark_df.columns, spark_df.collect()), rows_of(names, result.fetchall())
    missing, extra = theirs - mine, mine - theirs
    if not missing and not extra:
        return ""
    return f"{missing.total()} missing, {extra.total()} extra: {list(missing)[:2]} {list(extra)[:2]}"
