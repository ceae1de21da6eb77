"""Truncated SVD of sparse rows by a randomised range finder and tall-skinny QR.

The matrix is kept in tiles: some rows by some columns. What is as long as the
rows, or as the columns, is a table of blocks, and a product is a meeting of
tiles with blocks. Orthogonal factors are never formed: a block table goes
with a small square matrix that makes its columns orthonormal, found by QR in
every task and of the stacked triangles after that. The driver and every
closure hold such small matrices only, whatever the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import discard, durable, stored

# Columns beyond k that the sketch has, power iterations, rows of a block,
# numbers in a block of columns, blocks of rows that one task meets with a
# block of columns at least, entries of the matrix and numbers in blocks of
# rows that it meets at most, and tasks that merge triangles before the driver
# does.
OVERSAMPLE = 10
POWER = 5
BLOCK_ROWS = 1024
COLUMN_CELLS = 1 << 22
BAND_BLOCKS = 8
BAND_CELLS = 1 << 22
ROW_CELLS = 1 << 24
FAN = 8
# Solving by steps: numbers in a part of columns, and entries of the matrix in one, at most; entries below which
# parts are not made for the sake of more tasks.
PART_CELLS = 1 << 23
PART_ENTRIES = 12 << 20
LEAST_ENTRIES = 1 << 19
# Where solving by steps ends: the squares' relative change, and steps at most.
TOLERANCE = 1e-10
MOST_STEPS = 300

BLOCKS = "block long, m binary"


@dataclass
class SvdTable:
    """Right singular vectors as a table (column, vec), singular values, shares of variance."""

    components: DataFrame
    singular_values: np.ndarray
    ratios: list[float]


@dataclass
class _Matrix:
    """Rows by columns in tiles (block, part, rows, columns, values); ids of each block of rows."""

    tiles: DataFrame
    ids: DataFrame
    rows: int
    columns: int
    part: int  # columns of a part
    bands: int


def _tile(df: DataFrame, features: str, id_col: str, width: int) -> _Matrix:
    """Cut sparse or dense ML vectors into tiles; rows are numbered where they lie."""
    raw = F.unwrap_udt(F.col(features))
    indices = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    rows = df.select(
        id_col,
        F.when(F.size(raw["values"]) > 0, indices).alias("i"),
        F.when(F.size(raw["values"]) > 0, raw["values"]).alias("v"),
        F.coalesce(raw["size"], F.size(raw["values"])).alias("size"),
    )
    kind = df.schema[id_col].dataType.simpleString()
    columns = rows.agg(F.max("size")).first()[0] or 0
    part = max(64, COLUMN_CELLS // max(width, 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(start, BLOCK_ROWS)
                sizes = some.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(some.num_rows), sizes)
                column, value = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
                order = np.argsort(column // part, kind="stable")
                row, column, value = row[order], column[order], value[order]
                parts, starts = np.unique(column // part, return_index=True)
                stops = np.append(starts[1:], len(column))
                spans = list(zip(parts.tolist(), starts.tolist(), stops.tolist())) or [(0, 0, 0)]
                n = len(spans)
                # Ids go with the first tile of their block.
                ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                ids = pa.concat_arrays([ids, pa.nulls(n - 1, ids.type)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * n, pa.int64()),
                        pa.array([p for p, _, _ in spans], pa.int64()),
                        pa.array([some.num_rows] * n, pa.int32()),
                        pa.array([row[a:b].astype("<i4").tobytes() for _, a, b in spans], pa.binary()),
                        pa.array([(column[a:b] - p * part).astype("<i4").tobytes() for p, a, b in spans], pa.binary()),
                        pa.array([value[a:b].astype("<f8").tobytes() for _, a, b in spans], pa.binary()),
                        ids,
                    ],
                    names=["block", "part", "height", "rows", "columns", "values", "ids"],
                )
                number += 1

    schema = "block long, part long, height int, rows binary, columns binary, values binary"
    whole = durable(rows.select(id_col, "i", "v").mapInArrow(cut, f"{schema}, ids array<{kind}>"))
    ids = whole.where("ids IS NOT NULL").select("block", "ids", "height")
    seen = ids.agg(F.sum("height").alias("rows"), F.count("*").alias("blocks")).first()
    of_part = whole.groupBy("part").agg(F.sum(F.octet_length("columns") / 4).alias("cells"))
    cells = of_part.agg(F.max("cells")).first()[0] or 0
    needed = max(-(-int(cells) // BAND_CELLS), -(-(seen.rows or 0) * width // ROW_CELLS))
    bands = max(1, min(needed, -(-seen.blocks // BAND_BLOCKS)))
    return _Matrix(whole.drop("ids"), ids.drop("height"), seen.rows or 0, columns, part, bands)


def _band(column: str, bands: int):
    return F.pmod(F.xxhash64(column), F.lit(bands)).cast("long")


def _sum_blocks(partial: DataFrame) -> DataFrame:
    """(block, m): the sums of partial blocks of one number; each comes together in one task, one at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for batch in batches:
            for number, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(m.as_buffer())
                if number != block and block is not None:
                    yield _rows([block], [total])
                block, total = number, own.copy() if number != block else total + own
        if block is not None:
            yield _rows([block], [total])

    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(add, BLOCKS)


def _rows(blocks: list[int], matrices: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(blocks, pa.int64()), pa.array([m.tobytes() for m in matrices], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "m"])


def _times(a: _Matrix, z: DataFrame, t: np.ndarray) -> DataFrame:
    """A · (Z · t) as blocks of rows; ``z`` are blocks of columns."""
    tiles = a.tiles.withColumn("band", _band("block", a.bands))
    bands = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a.bands - 1).cast("long")))
    others = z.select(F.col("block").alias("own"), "m").withColumn("line", bands)
    shared = z.sparkSession.sparkContext.broadcast(t)  # as many rows and columns as the sketch has

    def meet(own: pa.Table, facing: pa.Table) -> pa.Table:
        out = []
        if len(facing) and len(own):
            z = np.frombuffer(facing["m"][0].as_py()).reshape(-1, len(shared.value)) @ shared.value
            for height, *parts in zip(*(own[c].to_pylist() for c in ("height", "rows", "columns", "values"))):
                rows, columns, values = (np.frombuffer(x, k) for x, k in zip(parts, ("<i4", "<i4", "<f8")))
                out.append(_gather(height, rows, columns, values, z))
        blocks = own["block"].to_pylist() if out else []
        return pa.Table.from_batches([_rows(blocks, out)])

    pairs = tiles.groupBy("part", "band").cogroup(others.groupBy("own", "line"))
    return durable(_sum_blocks(pairs.applyInArrow(meet, BLOCKS)))


def _gather(height: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(height, width): for each row the sum of its values times rows of ``z``."""
    out = np.zeros((height, z.shape[1]))
    _add(out, rows, columns, values, z)
    return out


def _add(out: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, z: np.ndarray) -> None:
    """Add to each row of ``out`` its values times rows of ``z``."""
    step = max(1, (1 << 21) // max(z.shape[1], 1))
    order = np.argsort(rows, kind="stable")
    rows, columns, values = rows[order], columns[order], values[order]
    for start in range(0, len(rows), step):
        own = rows[start : start + step]
        found, first = np.unique(own, return_index=True)
        weighed = z[columns[start : start + step]] * values[start : start + step, None]
        out[found] += np.add.reduceat(weighed, first, axis=0)


def _transposed(a: _Matrix, y: DataFrame, t: np.ndarray) -> DataFrame:
    """Aᵀ · (Y · t) as blocks of columns; ``y`` are blocks of rows."""
    tiles = a.tiles.withColumn("band", _band("block", a.bands))
    parts = max(1, -(-a.columns // a.part))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    others = y.withColumnRenamed("block", "own").withColumn("line", _band("own", a.bands)).withColumn("lane", every)
    shared = y.sparkSession.sparkContext.broadcast(t)  # as many rows and columns as the sketch has
    size, columns = a.part, a.columns

    def meet(key: tuple, own: pa.Table, facing: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if not len(own):
            return pa.Table.from_batches([_rows([], [])])
        height = min(size, columns - part * size)
        total = np.zeros((height, shared.value.shape[1]))
        blocks = dict(zip(facing["own"].to_pylist(), facing["m"].to_pylist()))
        for block, *cells in zip(*(own[c].to_pylist() for c in ("block", "rows", "columns", "values"))):
            rows, column, values = (np.frombuffer(x, k) for x, k in zip(cells, ("<i4", "<i4", "<f8")))
            y = np.frombuffer(blocks[block]).reshape(-1, len(shared.value)) @ shared.value
            total += _gather(height, column, rows, values, y)
        return pa.Table.from_batches([_rows([part], [total])])

    pairs = tiles.groupBy("part", "band").cogroup(others.groupBy("lane", "line"))
    return durable(_sum_blocks(pairs.applyInArrow(meet, BLOCKS)))


def triangle(blocks: DataFrame, width: int) -> np.ndarray:
    """R of the QR of all blocks' rows: in every task, in FAN tasks, then here."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for m in batch.column(0):
                r = np.linalg.qr(np.vstack([r, np.frombuffer(m.as_buffer()).reshape(-1, width)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["m"])

    found = blocks.select("m").mapInArrow(reduce, "m binary")
    if blocks.rdd.getNumPartitions() > FAN * FAN:
        part = F.pmod(F.spark_partition_id(), F.lit(FAN))
        found = found.withColumn("part", part).repartitionById(FAN, "part").select("m").mapInArrow(reduce, "m binary")
    parts = [np.frombuffer(row.m).reshape(-1, width) for row in found.collect()]
    return np.linalg.qr(np.vstack(parts), mode="r") if parts else np.zeros((0, width))


def _orthonormal(blocks: DataFrame, width: int) -> np.ndarray:
    """The matrix that makes the blocks' columns orthonormal; directions they lack become zeros."""
    r = triangle(blocks, width)
    if not r.size:
        return np.zeros((width, 0))
    _, s, v = np.linalg.svd(r)
    s = np.append(s, np.zeros(width - len(s)))
    real = s > s[0] * 1e-12 if s[0] > 0 else np.zeros(width, bool)
    return v.T[:, real] / s[real]


def _each(blocks: DataFrame, width: int, make: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """One small row of numbers from every task's rows, made by ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [make(np.frombuffer(m.as_buffer()).reshape(-1, width)) for batch in batches for m in batch.column(0)]
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.stack(parts).tobytes()], pa.binary())], names=["m"]
            )

    raw = blocks.select("m").mapInArrow(run, "m binary").collect()
    return [x for row in raw for x in np.frombuffer(row.m).reshape(-1, width)]


def fit_svd_sketch(
    df: DataFrame,
    k: int,
    features: str = "features",
    id_col: str = "id",
    power: int = POWER,
    seed: int = 42,
) -> tuple[SvdTable, DataFrame]:
    """Truncated SVD of uncentred rows: (model, (id, vec) scores U · S).

    For any number of rows and columns; memory goes with ``k`` and the block
    sizes. The sketch has OVERSAMPLE more columns than asked for, and ``power``
    iterations sharpen it; a matrix of no higher rank than the sketch is
    decomposed exactly. Signs are those of ``fix_signs``. Fewer components
    come out where the rank is lower.
    """
    width = k + OVERSAMPLE
    a = _tile(df, features, id_col, width)
    width = min(width, max(1, min(a.rows, a.columns)))
    part, columns = a.part, a.columns
    start = _random(df.sparkSession, a, width, seed)
    y = _times(a, start, np.eye(width))
    turn = _orthonormal(y, width)
    kind = df.schema[id_col].dataType.simpleString()
    if not turn.shape[1]:  # no rows, or zeros alone
        none = np.zeros((width, 0))
        return SvdTable(_spread(start, width, none, part, columns), np.zeros(0), []), _named(y, a.ids, none, id_col, kind)
    for _ in range(power):
        z = _transposed(a, y, turn)
        inner = _orthonormal(z, turn.shape[1])
        y = _times(a, z, inner)
        turn = _orthonormal(y, inner.shape[1])
    z = _transposed(a, y, turn)
    inside = turn.shape[1]
    _, s, w = np.linalg.svd(np.vstack([triangle(z, inside), np.zeros((max(inside, 1), inside))]))
    real = min(k, int((s > (s[0] if len(s) else 0.0) * 1e-12).sum()) if inside else 0)
    s, w = s[:real], w.T[:, :real]
    right, left = w / s, turn @ w * s
    signs = _signs(z, inside, right)
    components = _spread(z, inside, right * signs, part, columns)
    scores = _named(y, a.ids, left * signs, id_col, kind)
    return SvdTable(components, s, _ratios(a, y, z, left, s)), scores


def _random(spark: SparkSession, a: _Matrix, width: int, seed: int) -> DataFrame:
    """Blocks of columns of normal numbers, the same for the same seed."""
    part, columns = a.part, a.columns
    parts = max(1, -(-columns // part))

    def random(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                height = min(part, columns - block * part)
                yield _rows([block], [np.random.default_rng([seed, block]).normal(size=(height, width))])

    return spark.range(parts).withColumnRenamed("id", "block").mapInArrow(random, BLOCKS)


@dataclass
class _Parts:
    """Rows by columns in parts: column c is column c // parts of part c % parts.

    Tiles are (part, block, height, rows, columns, values), sorted by row.
    """

    tiles: DataFrame
    ids: DataFrame
    rows: int
    columns: int
    parts: int


def _deal(df: DataFrame, features: str, id_col: str, width: int) -> _Parts:
    """Deal the columns of sparse or dense ML vectors to parts; rows are numbered where they lie."""
    raw = F.unwrap_udt(F.col(features))
    some = F.size(raw["values"]) > 0
    indices = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    rows = df.select(
        id_col,
        F.when(some, indices).alias("i"),
        F.when(some, raw["values"]).alias("v"),
        F.coalesce(raw["size"], F.size(raw["values"]), F.lit(0)).alias("size"),
    )
    kind = df.schema[id_col].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(start, BLOCK_ROWS)
                sizes = own.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                column, value = (own.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
                blobs = sizes.astype("<i4"), column.astype("<i4"), value.astype("<f8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([max(0, *own.column(3).to_pylist())], pa.int32()),
                        pa.array([len(column)], pa.int64()),
                        *[pa.array([x.tobytes()], pa.binary()) for x in blobs],
                        pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(0)),
                    ],
                    names=["block", "size", "cells", "sizes", "columns", "values", "ids"],
                )
                number += 1

    schema = f"block long, size int, cells long, sizes binary, columns binary, values binary, ids array<{kind}>"
    whole = stored(rows.mapInArrow(gather, schema), "svd")
    seen = whole.agg(F.max("size").alias("columns"), F.sum("cells").alias("cells"), F.sum(F.size("ids")).alias("rows")).first()
    columns, cells = seen.columns or 0, seen.cells or 0
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, cells // LEAST_ENTRIES)
    parts = max(1, -(-columns * width // PART_CELLS), -(-cells // PART_ENTRIES), tasks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *blobs, ids in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                sizes, column, value = (np.frombuffer(x, k) for x, k in zip(blobs, ("<i4", "<i4", "<f8")))
                row = np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)
                order = np.argsort(column % parts, kind="stable")
                row, column, value = row[order], column[order], value[order]
                found, starts = np.unique(column % parts, return_index=True)
                spans = list(zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(column)])) or [(0, 0, 0)]
                n = len(spans)
                named = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), ids.values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _, _ in spans], pa.int32()),
                        pa.array([block] * n, pa.int64()),
                        pa.array([len(sizes)] * n, pa.int32()),
                        pa.array([row[x:y].tobytes() for _, x, y in spans], pa.binary()),
                        pa.array([(column[x:y] // parts).astype("<i4").tobytes() for _, x, y in spans], pa.binary()),
                        pa.array([value[x:y].tobytes() for _, x, y in spans], pa.binary()),
                        pa.concat_arrays([named, pa.nulls(n - 1, named.type)]),  # with the first tile of a block
                    ],
                    names=["part", "block", "height", "rows", "columns", "values", "ids"],
                )

    schema = f"part int, block long, height int, rows binary, columns binary, values binary, ids array<{kind}>"
    both = stored(whole.select("block", "sizes", "columns", "values", "ids").mapInArrow(cut, schema), "svd")
    discard(whole)
    ids = stored(both.where("ids IS NOT NULL").select("block", "ids"), "svd")
    return _Parts(both, ids, seen.rows or 0, columns, parts)


def _columns(
    a: _Parts, y: DataFrame | None, t: np.ndarray | None, width: int, seed: int, last: Callable, schema: str
) -> DataFrame:
    """What ``last`` (part, z, tiles) makes of every part's z = Aᵀ · (Y · t), or random numbers if there is no ``y``.

    A task has one part, to which its tiles come with every block of rows. Only the tiles and z stay in memory.
    """
    tiles = a.tiles.select("part", "block", F.lit(1).alias("kind"), "height", "rows", "columns", "values")
    if y is not None:
        none = F.lit(b"")
        every = F.explode(F.sequence(F.lit(0), F.lit(a.parts - 1)))
        blocks = y.select(every.alias("part"), "block", F.lit(0), F.lit(0), none, none, "m")
        tiles = tiles.union(blocks)
    stream = tiles.repartitionById(a.parts, "part").sortWithinPartitions("part", "block", "kind")
    shared = stream.sparkSession.sparkContext.broadcast(t)  # as many rows and columns as the sketch has
    parts, every_column = a.parts, a.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, z, part, facing, held = shared.value, None, None, (None, None), []
        for batch in batches:
            small, blobs = [batch.column(c).to_pylist() for c in range(4)], batch.columns[4:]
            for i, (own, block, kind, height) in enumerate(zip(*small)):
                if z is None:
                    part, size = own, (max(0, -(-(every_column - own) // parts)), width)
                    z = np.zeros(size) if t is not None else np.random.default_rng([seed, part]).normal(size=size)
                if not kind:
                    facing = block, blobs[2][i]
                    continue
                rows, columns, values = (np.frombuffer(x[i].as_py(), k) for x, k in zip(blobs, ("<u2", "<i4", "<f8")))
                held.append((block, height, rows, columns, values))
                if facing[0] == block:
                    _add(z, columns, rows, values, np.frombuffer(facing[1].as_buffer()).reshape(-1, len(t)) @ t)
        if held:
            yield from last(part, z, held)

    return stream.mapInArrow(run, schema)


def _step(a: _Parts, y: DataFrame | None, t: np.ndarray | None, width: int, seed: int) -> DataFrame:
    """A · z for the z of :func:`_columns` as blocks of rows, and triangles of z's parts as blocks below zero."""

    def last(part: int, z: np.ndarray, held: list) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for start in range(0, len(z), 1 << 14):
            r = np.linalg.qr(np.vstack([r, z[start : start + (1 << 14)]]), mode="r")
        yield _rows([-1 - part], [r])
        for block, height, rows, columns, values in held:
            yield _rows([block], [_gather(height, rows, columns, values, z)])

    return stored(_sum_blocks(_columns(a, y, t, width, seed, last, BLOCKS)), "svd")


def fit_svd_steps(
    df: DataFrame, k: int, features: str = "features", id_col: str = "id", seed: int = 42
) -> tuple[SvdTable, DataFrame]:
    """Truncated SVD of uncentred rows, iterated until it stands: (model, (id, vec) scores A · V).

    A subspace of twice ``k`` more columns, OVERSAMPLE at least, is multiplied by AᵀA
    until no square of the first ``k`` singular values changes by a share of
    TOLERANCE, MOST_STEPS times at most. Both products of a step are made in
    one pass over parts of columns. What is as long as the columns stays in
    the tasks; blocks of rows are written, and deleted after the next step.
    """
    width = k + max(OVERSAMPLE, 2 * k)
    a = _deal(df, features, id_col, width)
    width = min(width, max(1, min(a.rows, a.columns)))
    kind = df.schema[id_col].dataType.simpleString()
    y = t = None
    before = np.zeros(0)
    for step in range(MOST_STEPS):
        found = _step(a, y, t, width, seed)
        inner = _orthonormal(found.where("block < 0"), width)
        inside = inner.shape[1]
        r = triangle(found.where("block >= 0"), width) @ inner
        _, s, w = np.linalg.svd(np.vstack([r, np.zeros((max(inside, 1), inside))]))
        real = int((s > (s[0] if len(s) else 0.0) * 1e-12).sum()) if inside else 0
        top = s[: min(k, real)] ** 2
        stands = len(before) == len(top) and (np.abs(top - before) <= TOLERANCE * top).all()
        if not real or stands or step == MOST_STEPS - 1:
            break
        if y is not None:
            discard(y)
        before, y, t, width = top, found, inner @ (w.T[:, :real] / s[:real]), real
        y = y.where("block >= 0")
    s, right = s[: len(top)], inner @ w.T[:, : len(top)]
    scores = found.where("block >= 0")
    ends = stored(_ends(a, y, t, width, seed, right), "svd")
    for table in (a.tiles, *([] if y is None else [y])):
        discard(table)
    if not len(s):  # no rows, or zeros alone
        return SvdTable(_dealt_back(ends, a, np.ones(0)), s, []), _named(scores, a.ids, right, id_col, kind)
    peaks = ends.select("part", "at", "peaks", "squares", "weight").collect()  # a row for each part
    at = np.array([[p.part + a.parts * i for i in p.at] for p in peaks])
    high = np.array([p.peaks for p in peaks])
    first = [np.lexsort((at[:, i], -np.abs(high[:, i])))[0] for i in range(len(s))]
    signs = np.where(high[first, np.arange(len(s))] < 0, -1.0, 1.0)
    sums = np.sum(_each(scores, width, lambda m: m.sum(axis=0)), axis=0) @ right
    spread = sum(p.weight for p in peaks) - sum(p.squares for p in peaks) / a.rows
    ratios = ((s**2 - sums**2 / a.rows) / max(spread, np.finfo(float).tiny)).tolist()
    model = SvdTable(_dealt_back(ends, a, signs), s, ratios)
    return model, _named(scores, a.ids, right * signs, id_col, kind)


def _ends(a: _Parts, y: DataFrame | None, t: np.ndarray | None, width: int, seed: int, right: np.ndarray) -> DataFrame:
    """z · right of every part, its largest entries and where, and squares of the matrix: of column sums, of entries."""

    def last(part: int, z: np.ndarray, held: list) -> Iterator[pa.RecordBatch]:
        sums, weight = np.zeros(len(z)), 0.0
        for _, _, _, columns, values in held:
            sums += np.bincount(columns, values, len(z))
            weight += float(values @ values)
        m = z @ right
        at = np.abs(m).argmax(axis=0) if len(m) else np.zeros(m.shape[1], np.int64)
        numbers = pa.list_(pa.int64()), pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([m.tobytes()], pa.binary()),
                pa.array([at.tolist()], numbers[0]),
                pa.array([m[at, np.arange(m.shape[1])].tolist() if len(m) else []], numbers[1]),
                pa.array([float(sums @ sums)]),
                pa.array([weight]),
            ],
            names=["part", "m", "at", "peaks", "squares", "weight"],
        )

    schema = "part int, m binary, at array<long>, peaks array<double>, squares double, weight double"
    return _columns(a, y, t, width, seed, last, schema)


def _dealt_back(ends: DataFrame, a: _Parts, signs: np.ndarray) -> DataFrame:
    """(column, vec): a row for every column, zeros where no row has one of its part."""
    parts, columns = a.parts, a.columns
    every = ends.sparkSession.range(min(parts, columns)).select(F.col("id").cast("int").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = np.arange(part, columns, parts)
                own = np.zeros((len(numbers), len(signs)))
                if m is not None:
                    own = np.frombuffer(m).reshape(own.shape) * signs
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), _lists(own)], names=["column", "vec"])

    return every.join(ends, "part", "left").select("part", "m").mapInArrow(run, "column long, vec array<double>")


def _signs(z: DataFrame, width: int, right: np.ndarray) -> np.ndarray:
    """Turn each component so that its largest entry is positive; the first block wins ties."""
    def peak(m: np.ndarray) -> np.ndarray:
        own = m @ right
        out = np.zeros(width)
        out[: right.shape[1]] = own[np.abs(own).argmax(axis=0), np.arange(right.shape[1])]
        return out

    peaks = np.stack(_each(z.orderBy("block"), width, peak))[:, : right.shape[1]]
    signs = np.sign(peaks[np.abs(peaks).argmax(axis=0), np.arange(right.shape[1])])
    return np.where(signs == 0, 1.0, signs)


def _ratios(a: _Matrix, y: DataFrame, z: DataFrame, left: np.ndarray, s: np.ndarray) -> list[float]:
    """Variance of each score column over the total variance of the input columns."""
    n = a.rows
    sums = np.sum(_each(y, len(left), lambda m: m.sum(axis=0)), axis=0) @ left
    ones = a.tiles.select("block", "height").distinct().mapInArrow(_ones, BLOCKS)
    totals = _transposed(a, ones, np.eye(1))
    squares = float(np.sum(_each(totals, 1, lambda m: np.array([(m**2).sum()])))) / n
    weight = a.tiles.mapInArrow(_squares, "m double").agg(F.sum("m")).first()[0] or 0.0
    return ((s**2 - sums**2 / n) / max(weight - squares, np.finfo(float).tiny)).tolist()


def _ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, height in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield _rows([block], [np.ones((height, 1))])


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [float((np.frombuffer(v, "<f8") ** 2).sum()) for v in batch.column("values").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], names=["m"])


def _lists(m: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(m.ravel()))


def _spread(z: DataFrame, width: int, right: np.ndarray, part: int, columns: int) -> DataFrame:
    """(column, vec): a row for every column, zeros where no row has one of its part."""
    every = z.sparkSession.range(-(-columns // part)).withColumnRenamed("id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                height = min(part, columns - block * part)
                own = np.zeros((height, right.shape[1]))
                if m is not None:
                    own = np.frombuffer(m).reshape(height, width) @ right
                numbers = pa.array(block * part + np.arange(height), pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, _lists(own)], names=["column", "vec"])

    return every.join(z, "block", "left").select("block", "m").mapInArrow(run, "column long, vec array<double>")


def _named(y: DataFrame, ids: DataFrame, left: np.ndarray, id_col: str, kind: str) -> DataFrame:
    """(id, vec): the rows' scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, m in enumerate(batch.column(1).to_pylist()):
                own = batch.column(0)[i].values
                rows = np.zeros((len(own), left.shape[1])) if m is None else np.frombuffer(m).reshape(len(own), -1) @ left
                yield pa.RecordBatch.from_arrays([own, _lists(rows)], names=[id_col, "vec"])

    both = ids.join(y, "block", "left").select("ids", "m")
    return both.mapInArrow(run, f"`{id_col}` {kind}, vec array<double>")
