"""Runs a query and its SQL on the same tables and compares them as the driver does."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows: list, columns: list[str]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join("null" if r[i] is None else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty if columns and rows agree."""
    rel = con.sql(sql)
    rows, columns = rel.fetchall(), list(rel.columns)
    if sorted(columns) != sorted(spark_df.columns):
        return [f"columns {sorted(columns)} and {sorted(spark_df.columns)}"]
    here, there = canonical([tuple(r) for r in spark_df.collect()], spark_df.columns), canonical(rows, columns)
    if here == there:
        return []
    left, right = set(here), set(there)
    return [f"{len(here)} and {len(there)} rows", *sorted(left - right)[:3], *sorted(right - left)[:3]]
