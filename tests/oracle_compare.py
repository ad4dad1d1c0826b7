"""Compare a Spark result with its DuckDB counterpart, exactly."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


_FAMILIES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when columns, types, row count and every value agree."""
    relation = con.sql(sql)
    found = []
    if sorted(spark_df.columns) != sorted(relation.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(relation.columns)}"]
    types = dict(zip(relation.columns, [str(t) for t in relation.types], strict=True))
    for name, t in spark_df.dtypes:
        if _FAMILIES.get(t, t) != types[name]:
            found.append(f"type of {name}: {t} != {types[name]}")
    names = sorted(spark_df.columns)
    left = sorted(tuple(_cell(row[c]) for c in names) for row in spark_df.collect())
    position = [relation.columns.index(c) for c in names]
    right = sorted(tuple(_cell(row[p]) for p in position) for row in relation.fetchall())
    if len(left) != len(right):
        found.append(f"rows {len(left)} != {len(right)}")
    bad = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
    if bad:
        found.append(f"{len(bad)} rows differ, first: {dict(zip(names, zip(*bad[0], strict=True), strict=True))}")
    return found
