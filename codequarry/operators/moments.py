"""Incremental PCA: a state of counts, means and scatter that is stored, extended and merged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.vectors import lengths, matrix
from codequarry.operators.reduction import PcaModel, fix_signs

# Tasks that merge states before the driver does.
FAN = 8


@dataclass
class Moments:
    """Rows seen, their mean, and their scatter about it (width × width)."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of_rows(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        return Moments(len(x), mean, (x - mean).T @ (x - mean))

    def merge(self, other: Moments) -> Moments:
        """The state of both states' rows: means are shifted, so no digits cancel."""
        if not self.n or not other.n:
            return self if self.n else other
        if len(self.mean) != len(other.mean):
            raise ValueError(f"widths differ: {len(self.mean)} and {len(other.mean)}")
        n = self.n + other.n
        gap = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), scatter)

    def extend(self, batch: DataFrame, vec: str = "vec") -> Moments:
        """The state after a new batch, which alone is read."""
        return self.merge(moments(batch, vec, len(self.mean) if self.n else None))

    def covariance(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)

    def model(self, k: int) -> PcaModel:
        """The PCA of all rows seen so far."""
        values, vectors = np.linalg.eigh(self.covariance())
        top = np.argsort(values, kind="stable")[::-1][:k]
        total = values.sum()
        ratios = values[top] / total if total > 0 else np.zeros(len(top))
        return PcaModel(self.mean, fix_signs(vectors[:, top]), [float(r) for r in ratios])

    def write(self, spark: SparkSession, path: str) -> None:
        """Store the state as a table (i, n, mean, scatter): a row for each dimension."""
        rows = [(i, self.n, float(m), s.tolist()) for i, (m, s) in enumerate(zip(self.mean, self.scatter))]
        table = spark.createDataFrame(rows, "i int, n long, mean double, scatter array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Moments:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r.i)  # a row for each dimension
        if not rows:
            return nothing()
        return Moments(rows[0].n, np.array([r.mean for r in rows]), np.array([r.scatter for r in rows]))


def nothing() -> Moments:
    """The state before any row."""
    return Moments(0, np.zeros(0), np.zeros((0, 0)))


def _packed(state: Moments) -> pa.RecordBatch:
    flat = np.concatenate([[float(state.n)], state.mean, state.scatter.ravel()])
    return pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["state"])


def _unpacked(raw: bytes) -> Moments:
    flat = np.frombuffer(raw)
    width = int(round((np.sqrt(4 * len(flat) - 3) - 1) / 2))
    return Moments(int(flat[0]), flat[1 : width + 1], flat[width + 1 :].reshape(width, width))


def moments(df: DataFrame, vec: str = "vec", width: int | None = None) -> Moments:
    """The state of ``df``'s vectors, in one pass.

    A task makes one state of its rows, FAN tasks merge those, and the driver
    the last few. Vectors must be of one width (that of most rows, unless
    ``width`` says); others, and those with a NULL, are left out.
    """
    if width is None:
        widths = df.where(F.size(vec) > 0).groupBy(F.size(vec).alias("width")).count()
        first = widths.orderBy(F.desc("count"), "width").first()
        if first is None:
            return nothing()
        width = first.width

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = nothing()
        for batch in batches:
            rows = np.flatnonzero(lengths(batch.column(0)) == width)
            x = matrix(batch.column(0).take(pa.array(rows)), width)
            x = x[~np.isnan(x).any(axis=1)]
            if len(x):
                state = state.merge(Moments.of_rows(x))
        if state.n:
            yield _packed(state)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = nothing()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                state = state.merge(_unpacked(raw))
        if state.n:
            yield _packed(state)

    parts = df.select(vec).mapInArrow(gather, "state binary")
    part = F.pmod(F.spark_partition_id(), F.lit(FAN))
    merged = parts.withColumn("part", part).repartitionById(FAN, "part").select("state").mapInArrow(merge, "state binary")
    state = nothing()
    for row in merged.collect():  # FAN states at most
        state = state.merge(_unpacked(row.state))
    return state
