"""Vector tables: parquet with an explicit id and an ``array<float>`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.sources.tables import write_table


def _fits(vec: Column, dim: int) -> Column:
    whole = (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())
    return F.coalesce(whole, F.lit(False))


def normalise_vectors(df: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """Vectors of exactly ``dim`` floats; ragged, NULL and gappy rows removed.

    :func:`vector_reject_counts` says how many were.
    """
    floats = F.transform(F.col(vec), lambda x: x.cast("float"))
    return df.where(_fits(F.col(vec), dim)).withColumn(vec, floats)


def vector_reject_counts(df: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """One row: vectors kept and vectors rejected by :func:`normalise_vectors`."""
    fits = _fits(F.col(vec), dim)
    return df.agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("rejected"))


def write_vectors(
    df: DataFrame, target: str, id_col: str = "id", vec: str = "vec", mode: str = "overwrite"
) -> None:
    floats = F.col(vec).cast("array<float>").alias("vec")
    write_table(df.select(F.col(id_col).cast("bigint").alias("id"), floats), target, mode)


def read_vectors(spark: SparkSession, source: str, dim: int | None = None) -> DataFrame:
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    df = df.select("id", "vec")
    return df if dim is None else normalise_vectors(df, dim)


def vector_to_columns(df: DataFrame, dim: int, vec: str = "vec", prefix: str = "c") -> DataFrame:
    """Replace the vector column by ``dim`` columns ``c0, c1, …``.

    A vector of another width ends the job: no element is dropped.
    """
    rest = [name for name in df.columns if name != vec]
    wrong = F.size(vec) != dim
    df = df.withColumn(vec, F.when(wrong, F.raise_error(F.lit(f"a vector is not {dim} wide"))).otherwise(F.col(vec)))
    return df.select(*rest, *[F.get(vec, F.lit(i)).alias(f"{prefix}{i}") for i in range(dim)])


def columns_to_vector(df: DataFrame, columns: Sequence[str], vec: str = "vec") -> DataFrame:
    """Replace the listed columns by one float vector."""
    rest = [name for name in df.columns if name not in set(columns)]
    return df.select(*rest, F.array(*[F.col(c).cast("float") for c in columns]).alias(vec))


def import_positional(
    df: DataFrame, position: str, base: int = 1, id_col: str = "id"
) -> DataFrame:
    """Give rows known by a 0-based saved position their table id."""
    rest = [name for name in df.columns if name != position]
    return df.select((F.col(position).cast("bigint") + base).alias(id_col), *rest)
