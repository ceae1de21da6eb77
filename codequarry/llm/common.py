"""What the operators share: registration, input columns, row blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

# Rows in one Arrow batch. Texts are long; Spark's 10,000 would be some
# hundred megabytes.
BATCH_ROWS = 512

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


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


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, for an Arrow step, in batches of bounded size.

    Extra columns, whatever their names, go no further than here.
    """
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(F.col(key), F.col(text))


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def letter_crc(key: Column | str) -> Column:
    """The CRC-32 of a key written as text, by which rows are dealt into folds."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def rows_of(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``limit`` bytes, one row at least."""
    start, n = 0, batch.num_rows
    while start < n:
        stop, size = start + 1, batch.slice(start, 1).nbytes
        while stop < n and size < limit:
            size += batch.slice(stop, 1).nbytes
            stop += 1
        yield batch.slice(start, stop - start)
        start = stop


class Recent(dict):
    """A memo of ``compute`` that holds about ``limit`` bytes, twice over.

    When it is full its entries become the old generation, and the generation
    before them is forgotten; what is still in use moves over. Long items are
    not kept at all. What is forgotten is computed again, so the bound never
    changes a result. Items and values have a length.
    """

    LONGEST, ENTRY = 256, 200  # items kept, and bytes of an entry beside its contents

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old, self.size = compute, limit, {}, 0

    def __missing__(self, item):
        value = self.old.get(item)
        if value is None:
            value = self.compute(item)
        if len(item) > self.LONGEST:
            return value
        if self.size >= self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self[item] = value
        self.size += self.ENTRY + len(item) + len(value)
        return value


def text_name(text: Column | str) -> Column:
    """128 bits of a text's SHA-256, by which rows of one text share what follows from it; NULL for NULL."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def load() -> dict[str, Entry]:
    """All entries, in a fixed order."""
    from codequarry.llm import queries  # noqa: F401

    return dict(ENTRIES)
