"""Exact silhouettes: blocks of rows met by blocks of rows, on executors.

Every pair of rows is measured for all labellings at once, and no pair is a row.
A task meets a lane of blocks with another lane and adds up, for each row of
both, what it is away from each cluster of the other lane; lanes meet once, and
only within a lane is a pair measured from either side. The sums of a block's
rows then come together, and give the scores where the last of them arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.vectors import matrix
from codequarry.session import durable

# Rows of a block, and blocks of a lane.
BLOCK_ROWS = 512
LANE_BLOCKS = 16

_Table = list[tuple[int, int, int]]  # (labelling, cluster, rows), in order


def _blocks(points: DataFrame, id_col: str) -> DataFrame:
    kind = points.schema[id_col].dataType.simpleString()
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                x = matrix(part.column(1), len(part.column(1)[0]))
                labels = part.column(2).flatten().cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([part.num_rows], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                        pa.array([labels.to_pylist()], longs),
                        pa.array([x.tobytes()], pa.binary()),
                    ],
                    names=["block", "rows", "ids", "labels", "x"],
                )
                number += 1

    return points.mapInArrow(run, f"block long, rows int, ids array<{kind}>, labels array<long>, x binary")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """From each row of ``x`` to each row of ``y``."""
    gaps = x @ y.T
    gaps *= 2.0
    np.subtract(np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y), gaps, out=gaps)
    np.maximum(gaps, 0.0, out=gaps)
    return np.sqrt(gaps, out=gaps)


def _scores(own: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouette per row from its distance sums to every cluster."""
    rows = np.arange(len(own))
    within = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[rows, own] = np.inf
    other = means.min(axis=1)  # infinite if there is one cluster
    with np.errstate(all="ignore"):
        score = (other - within) / np.maximum(other, within)
    return np.where((sizes[own] > 1) & np.isfinite(score), score, 0.0)


def _members(labels: np.ndarray, table: _Table) -> np.ndarray:
    """(rows, clusters of all labellings): where each row belongs."""
    return np.stack([labels[:, way] == cluster for way, cluster, _ in table], axis=1).astype(np.float64)


def _meetings(blocks: DataFrame, lanes: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of every two lanes, ``here`` not above ``there``, and of a lane with itself; ids go there only."""
    dealt = blocks.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    below = F.explode(F.sequence(F.lit(0), "lane"))
    here = dealt.withColumnRenamed("lane", "here").withColumn(
        "there", F.explode(F.sequence("here", F.lit(lanes - 1)))
    ).withColumn("ids", F.expr("if(here = there, ids, null)"))
    there = dealt.select("block", "rows", "labels", "x", F.col("lane").alias("there"), below.alias("here"))
    return here, there


def labelled_silhouettes(points: DataFrame, id_col: str) -> DataFrame:
    """(id, labels, scores): silhouettes of rows (id, vec, labels) under several labellings.

    ``labels`` has a cluster for each labelling, and vectors are of one width.
    Rows are told apart by their place in a block: repeated and NULL ids are
    rows like any other. The driver sees the clusters' sizes only.
    """
    kind = points.schema[id_col].dataType.simpleString()
    blocks = durable(_blocks(points.select(id_col, "vec", "labels"), id_col))
    ways = blocks.where("rows > 0").select(F.size("labels") / F.col("rows")).first()
    ways = int(ways[0]) if ways else 0
    cells = blocks.select(F.posexplode("labels").alias("at", "cluster"))
    sizes = cells.groupBy(F.pmod("at", F.lit(max(ways, 1))).alias("way"), "cluster").agg(F.count("*").alias("n"))
    table = [tuple(r) for r in sizes.orderBy("way", "cluster").collect()]  # a row a cluster
    lanes = max(1, -(-blocks.count() // LANE_BLOCKS))
    rows, others = _meetings(blocks, lanes)

    def meet(key: tuple, own: pa.Table, facing: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        if not len(own) or not len(facing):
            own, facing = own.slice(0, 0), facing.slice(0, 0)
        sides = []
        for n, labels, x in zip(*(facing[c].to_pylist() for c in ("rows", "labels", "x"))):
            y = np.frombuffer(x).reshape(n, -1)
            # Measured from the middle of the block, so that few digits cancel.
            middle = y.mean(axis=0)
            sides.append((y - middle, _members(np.array(labels, np.int64).reshape(n, ways), table), middle))
        out, back = [], [0.0] * len(sides)
        for n, labels, raw in zip(*(own[c].to_pylist() for c in ("rows", "labels", "x"))):
            x, total = np.frombuffer(raw).reshape(n, -1), 0.0
            members = None if same else _members(np.array(labels, np.int64).reshape(n, ways), table)
            for i, (y, facing_members, middle) in enumerate(sides):
                gaps = _distances(x - middle, y)
                total = total + gaps @ facing_members
                if not same:
                    back[i] = back[i] + gaps.T @ members
            out.append(total.tobytes())
        numbers = own["block"].to_pylist()
        # Ids and labels go along once, with the sums of the lane's own rows.
        ids, labels = own["ids"], own["labels"]
        if not same:
            numbers += facing["block"].to_pylist()
            out += [sums.tobytes() for sums in back]
            ids, labels = pa.nulls(len(out), ids.type), pa.nulls(len(out), labels.type)
        return pa.table(
            [pa.array(numbers, pa.int64()), ids, labels, pa.array(out, pa.binary())],
            names=["block", "ids", "labels", "sums"],
        )

    pairs = rows.groupBy("here", "there").cogroup(others.groupBy("here", "there"))
    partial = pairs.applyInArrow(meet, f"block long, ids array<{kind}>, labels array<long>, sums binary")
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = total = ids = labels = None
        for batch in batches:
            for i in range(batch.num_rows):
                number, own_ids, own_labels, sums = (c[i] for c in batch.columns)
                if number.as_py() != block:
                    if block is not None:
                        yield scored(total, ids, labels)
                    block, total, ids, labels = number.as_py(), 0.0, None, None
                total = total + np.frombuffer(sums.as_buffer())
                if own_labels.is_valid:
                    ids, labels = own_ids.values, np.array(own_labels.as_py(), np.int64)
        if block is not None:
            yield scored(total, ids, labels)

    def scored(total: np.ndarray, ids: pa.Array, labels: np.ndarray) -> pa.RecordBatch:
        sums, labels = total.reshape(len(ids), len(table)), labels.reshape(len(ids), ways)
        out = np.empty((len(ids), ways))
        for way in range(ways):
            part = [i for i, (w, _, _) in enumerate(table) if w == way]
            clusters = np.array([table[i][1] for i in part])
            own = np.searchsorted(clusters, labels[:, way])
            out[:, way] = _scores(own, sums[:, part], np.array([table[i][2] for i in part], np.float64))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(labels.tolist(), longs), pa.array(out.tolist(), doubles)],
            names=[id_col, "labels", "scores"],
        )

    together = partial.repartition("block").sortWithinPartitions("block")
    return together.mapInArrow(finish, f"`{id_col}` {kind}, labels array<long>, scores array<double>")
