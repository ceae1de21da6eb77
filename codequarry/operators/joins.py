"""Lookups, aligned joins, anti and semi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left lookup into a table with one row per key.

    Nothing is forced: Spark broadcasts the table if its bytes are few, and
    adaptive execution splits the partition of a hot key, the facts' side of a
    left join, over several tasks.
    """
    return facts.join(table, key, "left")


def attach_repo(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Files by archive name to the lowest repository index of that name.

    A file of an archive with no known repository keeps NULL.
    """
    by_name = repos.groupBy(F.col("name").alias("archive")).agg(F.min("index").alias("repo"))
    return lookup_join(files, by_name, "archive")


def join_coords(coords: DataFrame, clusters: DataFrame, key: str = "id") -> DataFrame:
    """Coordinates and cluster ids side by side, unmatched rows of both kept."""
    return coords.join(clusters, key, "full")


def hydrate(points: DataFrame, functions: DataFrame, key: str = "id") -> DataFrame:
    """Points with the columns of ``functions``; an unknown id gives NULLs."""
    return points.join(functions, key, "left")


def not_in(df: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``kept``; NULLs there remove nothing."""
    return df.join(kept.select(key), key, "left_anti")


def restrict_to(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(key), key, "left_semi")


def missing_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row: listed keys that ``df`` does not have."""
    return not_in(keys.select(key).distinct(), df, key).agg(F.count("*").alias("missing"))


def pair_vectors(
    a: DataFrame, b: DataFrame, key: str = "id", vec: str = "vec"
) -> DataFrame:
    """(key, a, b) for the keys both vector tables have."""
    left = a.select(key, F.col(vec).alias("a"))
    return left.join(b.select(key, F.col(vec).alias("b")), key)
