"""Named queries over the test tables, each with SQL that must agree.

A query is ``(spark, folder) -> DataFrame``. Where SQL cannot say what an
operator does, the query has none and the tests check invariants instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def register(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name!r} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by their key, before a step that is dear per row.

    The test tables are files of one row group, so one task reads a file.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def r6(x: Column | str) -> Column:
    """Six places, and no negative zero, so that two engines print alike."""
    return F.round(x, 6) + F.lit(0.0)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vector table as (id, vec, label)."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"
    )


def load() -> dict[str, Entry]:
    """All entries, in a fixed order."""
    from codequarry.catalog import (  # noqa: F401
        curating,
        learning,
        relational,
        searching,
        sourcing,
        statistics,
        texts,
    )

    return dict(ENTRIES)
