"""Spark results against DuckDB results, as multisets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns: list[str], records) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(repr(_plain(record[i])) for i in order) for record in records)


def compare(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str | None) -> str:
    """``ok …`` or ``FAIL …``; without SQL, only that the plan runs."""
    found = _rows(df.columns, df.collect())
    if sql is None:
        return f"ok   {found.total()} rows, no SQL"
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} != {sorted(names)}"
    expected = _rows(names, result.fetchall())
    if found == expected:
        return f"ok   {found.total()} rows"
    extra, lacking = found - expected, expected - found
    return (
        f"FAIL {found.total()} rows, expected {expected.total()}; {extra.total()} extra such as "
        f"{list(extra)[:3]}; {lacking.total()} missing such as {list(lacking)[:3]}"
    )
