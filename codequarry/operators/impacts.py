"""Text search on sparse weights: postings by falling impact, with the highest of every block.

A row can only beat a score if one of its terms gives it at least an equal
share of that score. The blocks at the head of each term's list give a score
that enough rows reach; after that only blocks whose highest impact reaches
the share are read, and the rows found there are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.tfidf import numbered_rows, term_counts
from codequarry.session import discard, write_table

# Postings of a block.
BLOCK_POSTINGS = 512
# Postings that an index is built from at a time: shuffle files of so many are on disk at once.
SLICE_POSTINGS = 1 << 27
# Ranges of columns that are counted for the slices.
SLICE_BINS = 4096


@dataclass
class ImpactIndex:
    """Postings (column, high, ids, weights), rows (id, columns, weights) and (term, idf, column), as stored."""

    postings: DataFrame
    rows: DataFrame
    idf: DataFrame
    id_col: str

    def weigh(self, text: str) -> dict[str, float]:
        """The text's terms that the index knows, weighed as its rows are."""
        return {term: own for term, _, own in self._known(text)}

    def _query(self, text: str) -> dict[int, float]:
        return {column: own for _, column, own in self._known(text)}

    def _known(self, text: str) -> list[tuple[str, int, float]]:
        spark = self.rows.sparkSession
        own = term_counts(spark.createDataFrame([(0, text)], "q int, text string"), "q", "text")
        found = [(r.term, r.column, r.tf * r.idf) for r in own.join(self.idf, "term").collect()]  # words of the query
        size = sum(w * w for _, _, w in found) ** 0.5
        return [(term, column, w / size) for term, column, w in found]

    def _blocks(self, query: dict[int, float]) -> DataFrame:
        known = self.postings.where(F.col("column").isin(sorted(query)))  # reaches the scan
        return known.withColumn("reach", F.col("high") * _weight(query))

    def _scored(self, found: DataFrame, query: dict[int, float], few: bool = False) -> DataFrame:
        """(id, score) of the rows in the blocks, which may be said to be few."""
        near = found.select(F.explode("ids").alias(self.id_col)).distinct()
        near = F.broadcast(near) if few else near
        rows = self.rows.join(near, self.id_col, "left_semi")
        weights = F.create_map(*[F.lit(x) for pair in sorted(query.items()) for x in pair])
        parts = F.zip_with("columns", "weights", lambda t, w: F.coalesce(F.try_element_at(weights, t), F.lit(0.0)) * w)
        score = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
        return rows.select(self.id_col, score.alias("score")).where("score > 0")

    def _floor(self, query: dict[int, float], k: int) -> float:
        """A score that ``k`` rows reach, by the first block of each term."""
        first = Window.partitionBy("column").orderBy(F.desc("reach"))
        head = self._blocks(query).withColumn("n", F.row_number().over(first)).where("n = 1")
        best = self._scored(head, query, few=True).orderBy(F.desc("score")).limit(k)
        seen = best.agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
        return seen.low if seen.n == k else 0.0

    def needed(self, query: dict[int, float], k: int) -> DataFrame:
        """The blocks that can hold one of the best ``k``, and may not be left out."""
        share = self._floor(query, k) / max(len(query), 1)
        return self._blocks(query).where(F.col("reach") >= share * (1 - 1e-9))

    def search(self, text: str, k: int) -> DataFrame:
        """(id, score): the best ``k`` rows by the cosine with ``text``, none without a common term."""
        query = self._query(text)
        if not query:
            return self.rows.limit(0).select(self.id_col, F.lit(0.0).alias("score"))
        found = self._scored(self.needed(query, k), query)
        return found.orderBy(F.desc("score"), self.id_col).limit(k)

    def skipped(self, text: str, k: int) -> DataFrame:
        """One row: postings blocks of the text's terms, and those that a search leaves unread."""
        query = self._query(text)
        read = self.needed(query, k).agg(F.count("*")).scalar() if query else F.lit(0)
        return self._blocks(query).agg(F.count("*").alias("blocks")).select("blocks", (F.col("blocks") - read).alias("skipped"))


def _weight(query: dict[int, float]) -> Column:
    weight = F.lit(0.0)
    for column, own in sorted(query.items()):
        weight = F.when(F.col("column") == column, own).otherwise(weight)
    return weight


def posting_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(column, high, ids, weights) of sorted (place, weight, id): each column cut after every ``most``.

    Blocks are ranges of the batches that came; the last, which the next batch
    may go on with, is kept for it.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        columns = batch.column(0).to_numpy() >> 32
        at = np.arange(len(columns))
        first = np.maximum.accumulate(np.where(np.append(True, columns[1:] != columns[:-1]), at, 0))
        starts = np.flatnonzero((at - first) % most == 0)
        if len(starts) > 1:
            yield _cut(batch.slice(0, starts[-1]), starts[:-1])
        held = batch.slice(starts[-1])
    if held is not None:
        yield _cut(held, np.zeros(1, np.int64))


def _cut(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    places, weights, ids = batch.columns
    columns = (places.to_numpy()[starts] >> 32).astype(np.int32)
    high = np.maximum.reduceat(weights.to_numpy(), starts)
    ends = pa.array(np.append(starts, batch.num_rows), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, values) for values in (ids, weights)]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns), pa.array(high), *lists], names=["column", "high", "ids", "weights"]
    )


def _spans(vocabulary: DataFrame) -> list[tuple[int, int]]:
    """Ranges of columns with about SLICE_POSTINGS postings each: one, if there are no more."""
    seen = vocabulary.agg(F.max("column").alias("last"), F.sum("df").alias("postings")).first()
    end = (seen.last or 0) + 1
    if (seen.postings or 0) <= SLICE_POSTINGS:
        return [(0, end)]
    size = -(-end // SLICE_BINS)
    bins = vocabulary.groupBy(F.floor(F.col("column") / size).alias("bin")).agg(F.sum("df").alias("n"))
    starts, held = [0], 0
    for row in bins.orderBy("bin").collect():  # SLICE_BINS rows at most
        if held and held + row.n > SLICE_POSTINGS:
            starts.append(row.bin * size)
            held = 0
        held += row.n
    return list(zip(starts, [*starts[1:], end]))


def build_impacts(df: DataFrame, path: str, id_col: str = "id", text: str = "text") -> ImpactIndex:
    """TF-IDF weights of whole texts as postings and as rows, written below ``path``.

    A term's postings are sorted over as many tasks as they need, so no term
    is too frequent: by one number, the term's column and 32 bits of the
    weight. Texts without terms are in no posting and found by nothing. What
    the rows are made from is deleted before postings are sorted. Both are
    made in slices of about SLICE_POSTINGS, of ids and of columns, whose
    shuffle files go when a slice is written.
    """
    read = df.sparkSession.read
    ids = df.schema[id_col].dataType.simpleString()
    scratch: list[DataFrame] = []
    rows, vocabulary = numbered_rows(df, id_col, text, scratch)
    spans = _spans(vocabulary)
    part = F.pmod(F.xxhash64(id_col), F.lit(len(spans)))
    for i in range(len(spans)):
        write_table(rows.where(part == i) if i or spans[1:] else rows, f"{path}/rows", "append" if i else "overwrite")
    idf = vocabulary.select("term", "idf", "column").repartitionByRange("term").sortWithinPartitions("term")
    write_table(idf, f"{path}/idf", "overwrite")
    for table in scratch:
        discard(table)
    rows = read.schema(f"`{id_col}` {ids}, columns array<int>, weights array<double>").parquet(f"{path}/rows")
    cells = F.arrays_zip(F.col("columns").alias("column"), F.col("weights").alias("weight"))
    weights = rows.select(id_col, F.inline(cells))
    low = F.least(F.floor(F.greatest(1 - F.col("weight"), F.lit(0.0)) * (1 << 32)), F.lit((1 << 32) - 1))
    place = F.shiftleft(F.col("column").cast("long"), 32) + low
    most = BLOCK_POSTINGS
    for i, (low_column, end) in enumerate(spans):
        some = weights.where(F.col("column").between(low_column, end - 1)) if spans[1:] else weights
        ordered = some.select(place.alias("place"), "weight", id_col).repartitionByRange("place", id_col)
        cut = ordered.sortWithinPartitions("place").mapInArrow(
            lambda batches: posting_blocks(batches, most),
            f"column int, high double, ids array<{ids}>, weights array<double>",
        )
        write_table(cut, f"{path}/postings", "append" if i else "overwrite")
    return ImpactIndex(
        read.schema(cut.schema).parquet(f"{path}/postings"),
        rows,
        read.schema("term string, idf double, column int").parquet(f"{path}/idf"),
        id_col,
    )
