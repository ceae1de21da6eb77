"""Slices, filters, lookups, row numbers, running totals and top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.session import durable


def head_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in a stated, unique order."""
    return df.orderBy(*order).limit(max(n, 0))


def slice_rows(df: DataFrame, order: Sequence[str], start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end - 1`` in a stated, unique order.

    Rows are numbered over all tasks and filtered, so what comes before the
    slice never meets in one task.
    """
    if start <= 0:
        return head_rows(df, order, end)
    place = "_place"
    while place in df.columns:
        place += "_"
    numbered = with_row_index(df, order, place)
    return numbered.where((F.col(place) >= start) & (F.col(place) < end)).drop(place)


def filter_len(
    df: DataFrame, col: str, gt: int | None = None, lt: int | None = None
) -> DataFrame:
    """Rows whose text length lies strictly between the bounds."""
    size = F.length(col)
    if gt is not None:
        df = df.where(size > gt)
    if lt is not None:
        df = df.where(size < lt)
    return df


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with one key value; the test reaches the parquet scan."""
    return df.where(F.col(key) == F.lit(value))


def changed_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two columns differ; a single NULL counts as a difference."""
    return df.where(~F.col(a).eqNullSafe(F.col(b)))


def union_fill(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by column name; columns one side lacks are NULL there."""
    return a.unionByName(b, allowMissingColumns=True)


def top_n(df: DataFrame, col: str, n: int, tie: str) -> DataFrame:
    """``n`` largest by ``col``, NULLs last, ties by ``tie``."""
    return df.orderBy(F.desc_nulls_last(col), tie).limit(n)


def argmax_row(df: DataFrame, score: str, tie: str) -> DataFrame:
    """The row with the highest score, the lowest ``tie`` among equals."""
    return top_n(df, score, 1, tie)


# Spark numbers rows within a partition in the low bits, partitions above them.
_ROW_BITS = 33


def _numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` in order, with its partition and its place there, written once.

    Spark's range partitioner samples the order and sorts the ranges. What it
    decided is kept with the rows, so a task that is run again, or another
    reader, sees the same places.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(ordered.withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_at", _ROW_BITS)).withColumn(
        "_at", F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    )


def _offsets(numbered: DataFrame, total: Column) -> DataFrame:
    """What all partitions before each one add up to: a row for each partition."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.groupBy("_part").agg(total.alias("_total"))
    return parts.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))


def with_row_index(df: DataFrame, order: Sequence[str], out: str = "row") -> DataFrame:
    """0-based row number in a stated order; equal rows are numbered in turn."""
    numbered = _numbered(df, order)
    offsets = _offsets(numbered, F.count("*"))
    return (
        numbered.join(F.broadcast(offsets), "_part")  # one row for each partition
        .withColumn(out, F.col("_at") + F.col("_offset"))
        .drop("_part", "_at", "_offset")
    )


def cumulative(df: DataFrame, order: Sequence[str], col: str, out: str) -> DataFrame:
    """Running total of ``col`` in a stated order."""
    numbered = _numbered(df, order)
    offsets = _offsets(numbered, F.sum(col))
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        numbered.withColumn("_inside", F.sum(col).over(upto))
        .join(F.broadcast(offsets), "_part")  # one row for each partition
        .withColumn(out, F.coalesce("_inside", F.lit(0)) + F.col("_offset"))
        .drop("_part", "_at", "_inside", "_offset")
    )
