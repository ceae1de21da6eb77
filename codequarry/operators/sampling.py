"""Repeatable samples and splits.

A row's draw is a digest of its key, so it does not depend on partitions, on
the other rows or on which executor runs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.operators.rows import with_row_index
from codequarry.session import durable

# Fixed value: the share of rows held out for testing.
TEST_SHARE = 0.15


def draw(key: str | Column, seed: int | str) -> Column:
    """32 hex digits, uniform over keys; NULL is a key like any other."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("\0"))))


def unit_draw(key: str | Column, seed: int | str) -> Column:
    """The first 32 bits of :func:`draw` as a number in [0, 1)."""
    bits = F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("double")
    return bits / float(2**32)


def sample_frac(df: DataFrame, frac: float, key: str, seed: int = 42) -> DataFrame:
    """About ``frac`` of the rows: one filter, no shuffle."""
    return df.where(unit_draw(key, seed) < frac)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) without replacement.

    The rows with the ``n`` lowest draws. Draws are counted by their leading
    digits, four more at a time, until one row, or rows of one draw, stand at
    place n; what lies below is one filter. Rows of one key share a draw: of
    those at place n, the lowest by their whole content fill the number up.
    Whole rows are never sorted or brought together, whatever ``n`` is.
    """
    if n <= 0:
        return df.limit(0)
    place = draw(key, seed)
    draws = df.select(place.alias("d"))
    prefix, digits = "", 0
    while True:
        digits += 4
        near = draws.where(F.startswith("d", F.lit(prefix)))
        cells = near.groupBy(F.substring("d", 1, digits).alias("cell")).agg(F.count("*").alias("n"))
        for cell in cells.orderBy("cell").collect():  # at most 16 ** 4 rows
            if cell.n >= n:
                break
            n -= cell.n
        else:
            return df
        prefix = cell.cell
        if cell.n == 1 or digits == 32:
            break
    whole = F.xxhash64(*[F.col(c) for c in df.columns])
    below = df.where(F.substring(place, 1, digits) < prefix)
    return below.union(df.where(F.startswith(place, F.lit(prefix))).orderBy(key, whole).limit(n))


def _content(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row's whole content."""
    parts = [
        F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields
    ]
    return [F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit("again"), *reversed(parts)).alias("_b")]


def sample_n_repl(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement, as rows with the number of the draw.

    Draws pick row numbers in key order, so repeated and NULL keys are drawn
    as often as any. Only keys and 128-bit hashes of the rows are sorted and
    numbered; whole rows move if they are drawn, and equal rows once.
    """
    narrow = df.select(F.col(key).alias("_key"), *_content(df))
    numbered = with_row_index(narrow, ["_key", "_a", "_b"], "_row")
    total = numbered.count()
    if not total:
        return df.withColumn("draw", F.lit(0).cast("bigint")).limit(0)
    bits = F.conv(F.substring(draw("draw", seed), 1, 12), 16, 10).cast("bigint")
    draws = (
        df.sparkSession.range(n)
        .withColumnRenamed("id", "draw")
        .withColumn("_row", F.pmod(bits, F.lit(total)))
    )
    picked = durable(numbered.join(draws, "_row").select("_a", "_b", "draw"))
    rows = df.select("*", *_content(df)).join(picked.select("_a", "_b"), ["_a", "_b"], "left_semi")
    return rows.dropDuplicates(["_a", "_b"]).join(picked, ["_a", "_b"]).select(*df.columns, "draw")


def split(
    df: DataFrame, key: str, test_share: float = TEST_SHARE, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint and complete; a row keeps its side as rows are added."""
    tagged = df.withColumn("_test", is_test(key, test_share, seed))
    return tagged.where("NOT _test").drop("_test"), tagged.where("_test").drop("_test")


def is_test(key: str | Column, test_share: float = TEST_SHARE, seed: int = 42) -> Column:
    return unit_draw(key, seed) < test_share
