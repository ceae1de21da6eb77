"""Counts, histograms, rasters, extents and deduplication.

Every aggregate here combines on the map side, so a key that holds a third of
the rows reaches its reducer as one partial row per task. Ranges found by one
aggregate and used by another travel as scalar subqueries, not as joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codequarry.functions.text import count_substring, parse_list_literal, tag_label
from codequarry.session import durable

# Tags seen more often than this are shown; the number of
# weighted tags shown; bytes in one mebibyte.
TAG_MIN_COUNT = 2
TAG_TOP = 50
MEBIBYTE = 1024 * 1024


def count_by(df: DataFrame, key: str, col: str, out: str = "n") -> DataFrame:
    """Non-null values of ``col`` per key, NULL keys dropped, keys as text."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(col).alias(out))
        .select(F.col(key).cast("string").alias(key), out)
    )


def corpus_stats(
    df: DataFrame, group: str, content: str, needle: str = "def "
) -> DataFrame:
    """One row: number of groups, mebibytes of text, occurrences of ``needle``."""
    per_group = df.groupBy(group).agg(
        F.sum(F.octet_length(content)).alias("bytes"),
        F.sum(count_substring(F.col(content), needle)).alias("hits"),
    )
    return per_group.agg(
        F.count(group).alias("groups"),
        (F.sum("bytes") / MEBIBYTE).alias("mebibytes"),
        F.sum("hits").alias("hits"),
    )


def _tags(df: DataFrame, topics: str) -> Column:
    typed = df.schema[topics].dataType
    if isinstance(typed, T.ArrayType):
        return F.col(topics)
    return parse_list_literal(F.col(topics))


def tag_counts(df: DataFrame, topics: str = "topics", min_count: int = TAG_MIN_COUNT) -> DataFrame:
    """How many rows carry each tag, for tags carried more than ``min_count`` times."""
    return (
        df.select(F.explode(_tags(df, topics)).alias("tag"))
        .groupBy(tag_label(F.col("tag")).alias("tag"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > min_count)
    )


def tag_weights(
    df: DataFrame, topics: str = "topics", size: str = "size", top: int = TAG_TOP
) -> DataFrame:
    """The ``top`` tags by the total size of the rows that carry them."""
    return (
        df.select(F.explode(_tags(df, topics)).alias("tag"), F.col(size).alias("size"))
        .groupBy(tag_label(F.col("tag")).alias("tag"))
        .agg(F.sum("size").alias("weight"))
        .orderBy(F.desc_nulls_last("weight"), "tag")
        .limit(top)
    )


def unparsed_topics(df: DataFrame, topics: str = "topics") -> DataFrame:
    """One row: lists written as text that could not be read as lists."""
    text = F.col(topics)
    return df.agg(
        F.count_if(text.isNotNull() & parse_list_literal(text).isNull()).alias("unparsed")
    )


def list_fill_stats(df: DataFrame, col: str) -> DataFrame:
    """One row: rows whose list has items, and rows whose list is empty."""
    return df.agg(
        F.count_if(F.size(col) > 0).alias("filled"), F.count_if(F.size(col) == 0).alias("empty")
    )


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the stated order; NULL keys count as equal.

    Rows are dealt and sorted by the digests of text keys, and texts are
    compared where digests agree, so two texts of one digest stay two. Spark
    limits each task to the first row per key before the shuffle, so a text
    copied into a third of all rows does not pile up.
    """
    text = [key for key in keys if isinstance(df.schema[key].dataType, T.StringType)]
    first = Window.partitionBy(*[F.md5(k) for k in text], *keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def extents(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: smallest and largest value of every listed column."""
    ends = [(F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")) for c in cols]
    return df.agg(*[end for pair in ends for end in pair])


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based equal-width bin; the last is closed; an empty range widens by ½; NULL has none."""
    flat = lo == hi
    start = F.when(flat, lo - 0.5).otherwise(lo)
    width = F.when(flat, F.lit(1.0)).otherwise(hi - lo) / bins
    at = F.floor((x - start) / width).cast("int") + 1
    return F.when(x.isNotNull(), F.least(at, F.lit(bins)))  # least() would pass over NULL


def _number(col: str) -> Column:
    """A column as doubles, NaN turned to NULL."""
    value = F.col(col).cast("double")
    return F.when(~F.isnan(value), value)


def _edges(lo: Column, hi: Column, bins: int) -> tuple[Column, Column]:
    flat = lo == hi
    start = F.when(flat, lo - 0.5).otherwise(lo)
    width = F.when(flat, F.lit(1.0)).otherwise(hi - lo) / bins
    return start + (F.col("bin") - 1) * width, start + F.col("bin") * width


# Leading bits of a number that make it a leaf of the bin tree, beside its exponent.
LEAF_BITS = 8


def _leaf(x: Column) -> Column:
    """Numbers of one exponent that agree in their leading bits are one leaf; zero and infinity are two."""
    exponent = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-1000))
    lead = F.floor(x / F.pow(F.lit(2.0), exponent - LEAF_BITS))
    odd = F.when(x == 0, -1).when(F.abs(x) == float("inf"), -2)
    return F.when(odd.isNotNull(), odd.cast("bigint")).otherwise(exponent * (8 << LEAF_BITS) + lead)


def _histograms(df: DataFrame, groups: Sequence[str], col: str, bins: int, density: bool) -> DataFrame:
    """One histogram per group over the group's own range, from one scan.

    The scan counts leaves: numbers that agree in exponent and leading bits,
    with the least and the greatest of them. Leaves combine on the map side
    and say the range. A leaf that an edge does not cut counts as a whole. Of
    those that are cut, one for each edge at most, the rows are read again,
    and no others; where no leaf is cut there is nothing to read.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    values = df.select(*(F.col(g).alias(k) for g, k in zip(groups, keys)), _number(col).alias("_x"))
    values = values.where("_x IS NOT NULL").withColumn("_leaf", _leaf(F.col("_x")))
    leaves = durable(
        values.groupBy(*keys, "_leaf").agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    )
    ranges = leaves.groupBy(*keys).agg(
        F.min("_low").alias("_lo"), F.max("_high").alias("_hi"), F.sum("_n").alias("_total")
    )
    ranges = ranges.where("_total > 0").select(*(F.col(k).alias(f"{k}r") for k in keys), "_lo", "_hi", "_total")

    def same(right: str) -> Column:
        every = [F.col(k).eqNullSafe(F.col(f"{k}{right}")) for k in keys]
        return reduce(Column.__and__, every, F.lit(True))

    lo, hi = F.col("_lo"), F.col("_hi")
    if keys:
        placed = leaves.join(ranges, same("r"))
    else:
        span = ranges.select(F.struct("_lo", "_hi").alias("span")).scalar()
        placed = leaves.withColumn("_lo", span["_lo"]).withColumn("_hi", span["_hi"])
    placed = placed.withColumn("bin", _bin(F.col("_low"), lo, hi, bins)).withColumn("_last", _bin(F.col("_high"), lo, hi, bins))
    whole = placed.where("bin = _last").select(*keys, "bin", "_n")
    cut = placed.where("bin <> _last").select(
        *(F.col(k).alias(f"{k}c") for k in keys), F.col("_leaf").alias("_cut"), "_lo", "_hi"
    )
    inside = values.join(cut if keys else F.broadcast(cut), same("c") & (F.col("_leaf") == F.col("_cut")))  # a leaf an edge
    parts = inside.groupBy(*keys, _bin(F.col("_x"), lo, hi, bins).alias("bin")).agg(F.count("*").alias("_n"))
    filled = whole.unionByName(parts).groupBy(*(F.col(k).alias(f"{k}f") for k in keys), F.col("bin").alias("_bin"))
    filled = filled.agg(F.sum("_n").alias("_count"))
    listed = ranges.select(
        *(F.col(f"{k}r").alias(k) for k in keys), "_lo", "_hi", "_total",
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"),
    )
    both = listed.join(filled, same("f") & (F.col("bin") == F.col("_bin")), "left")
    return _shown(both, bins, density, *(F.col(k).alias(g) for g, k in zip(groups, keys)))


def histogram(df: DataFrame, col: str, bins: int, density: bool = False) -> DataFrame:
    """(bin, lo, hi, n) over ``bins`` equal-width bins; empty bins are listed.

    NaN is left out, as NULL is. See :func:`_histograms` for the scan.
    """
    return _histograms(df, [], col, bins, density)


def _shown(listed: DataFrame, bins: int, density: bool, *keys: Column) -> DataFrame:
    lo, hi = _edges(F.col("_lo"), F.col("_hi"), bins)
    count = F.coalesce("_count", F.lit(0)).cast("bigint")
    shown = (count / (F.col("_total") * (hi - lo))) if density else count
    name = "density" if density else "n"
    return listed.select(*keys, "bin", lo.alias("lo"), hi.alias("hi"), shown.alias(name))


def histogram_by(
    df: DataFrame,
    group: str,
    col: str,
    bins: int,
    density: bool = False,
) -> DataFrame:
    """One histogram per group, each over the group's own range; NaN is left out.

    NULL is a group like any other. See :func:`_histograms` for the scan.
    """
    return _histograms(df, [group], col, bins, density)


def histogram_compare(populations: dict[str, DataFrame], col: str, bins: int) -> DataFrame:
    """Density histograms of several frames, labelled by their names."""
    tagged = [df.select(F.lit(name).alias("label"), col) for name, df in populations.items()]
    united = reduce(DataFrame.unionByName, tagged)
    return histogram_by(united, "label", col, bins, density=True)


def raster_counts(
    df: DataFrame, x: str, y: str, cat: str, width: int = 800, height: int = 600
) -> DataFrame:
    """Points per pixel and category; the far edges fall in the last pixel."""
    span = extents(df, [x, y]).select(F.struct("*")).scalar()

    def pixel(col: str, size: int) -> Column:
        lo, hi = span[f"{col}_min"], span[f"{col}_max"]
        at = F.coalesce(F.try_divide(F.col(col) - lo, hi - lo), F.lit(0.0)) * size
        return F.least(F.floor(at).cast("int"), F.lit(size - 1))

    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(pixel(x, width).alias("px"), pixel(y, height).alias("py"), cat)
        .agg(F.count("*").alias("n"))
    )


def longest(df: DataFrame, col: str, key: str) -> DataFrame:
    """The row with the longest text, the lowest key among equals."""
    size = F.length(col)
    return df.withColumn("length", size).orderBy(F.desc_nulls_last("length"), key).limit(1)
