"""Exact nearest neighbours by distances to pivots: one query on a stored index, or a join.

A row is dealt to its nearest pivot. By the triangle inequality the distance
of a query to a pivot, and of a row to it, bound the distance between the two;
rows, files and whole cells that the bounds rule out are never measured. The
answer is the one that measuring every row would give.

Cosine is measured between vectors of length one, where a smaller distance is
a larger cosine. A dot product is bounded by Cauchy and Schwarz instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.vectors import Kernel, l2_kernel, lengths, matrix, metric_kernel, minkowski_kernel
from codequarry.session import durable

# Pivots of an index, pivots of a join at most, rows drawn for each pivot, rows
# that one task meets with so many queries at least where there are as many.
# Rows that a task deals to cells at a time, and numbers in the copies that it
# sends at a time. Numbers in the rows, and in the queries, that meet in one
# task at most.
INDEX_PIVOTS = 8
MOST_PIVOTS = 256
DRAWN = 16
CELL_ROWS = 4096
QUERY_ROWS = 1024
DEAL_ROWS = 256
SENT_CELLS = 1 << 20
LANE_CELLS = 1 << 23
BAND_CELLS = 1 << 22
# Rows and queries whose distances are in memory at once.
NEAR_ROWS = 1024
NEAR_QUERIES = 256
# What rounding may add to or take from a bound, as a share of the distances it comes from.
SLACK = 1e-9


@dataclass
class Space:
    """How vectors are compared, and the metric that bounds it."""

    metric: str
    p: float

    def __post_init__(self):
        _, self.larger_is_nearer = metric_kernel(self.metric, self.p)
        self.bounded = self.metric != "minkowski" or self.p >= 1  # else there is no triangle inequality

    def place(self, x: np.ndarray) -> np.ndarray:
        """Rows as points; NaN where a row has no score with anything."""
        if self.metric != "cosine":
            return x
        with np.errstate(all="ignore"):
            return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(rows, points) distances between points."""
        kernel: Kernel = minkowski_kernel(self.p) if self.metric == "minkowski" else l2_kernel
        with np.errstate(all="ignore"):
            if self.metric == "minkowski" and self.p != 2:
                return np.stack([kernel(x, one[np.newaxis, :]) for one in y], axis=1)
            squares = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)
            rough = squares - 2.0 * (x @ y.T)
            row, other = np.nonzero(rough < 1e-6 * squares)  # few digits are left of these
            rough[row, other] = l2_kernel(x[row], y[other]) ** 2
            return np.sqrt(rough)


def _points(vectors: pa.Array, width: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can have a score with vectors of ``width``, their points)."""
    rows = np.flatnonzero(lengths(vectors) == width)
    x = space.place(matrix(vectors.take(pa.array(rows)), width))
    good = np.isfinite(x).all(axis=1)
    return rows[good], x[good]


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def choose_pivots(df: DataFrame, vec: str, count: int, space: Space) -> np.ndarray:
    """Up to ``count`` points far from each other, of DRAWN times as many rows.

    The rows of the lowest hashes are drawn, of the width that most rows have;
    the driver holds no more than these. Any pivots give right answers.
    """
    usable = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(F.col(vec).cast("array<double>").alias("v"))
    widths = usable.groupBy(F.size("v").alias("width")).count()
    first = widths.orderBy(F.desc("count"), "width").first()
    if first is None:
        return np.zeros((0, 0))
    drawn = usable.where(F.size("v") == first.width).orderBy(F.xxhash64("v"), "v").limit(count * DRAWN).toArrow()
    _, sample = _points(drawn["v"].combine_chunks(), first.width, space)
    if not len(sample):
        return np.zeros((0, first.width))
    chosen = [0]
    nearest = space.distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, space.distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


@dataclass
class PivotIndex:
    """Rows (id, vec) with a column of distances for each pivot, sorted by nearest pivot and distance."""

    rows: DataFrame
    pivots: np.ndarray
    space: Space
    id_col: str
    vec: str

    def _names(self) -> list[str]:
        return [f"d{i}" for i in range(len(self.pivots))]

    def near(self, query: Sequence[float], radius: float) -> DataFrame:
        """The rows that may lie within ``radius``: a range of every distance, which reaches the scan."""
        own = self.space.distances(self.space.place(np.asarray([query], np.float64)), self.pivots)[0]
        found = self.rows
        for name, d in zip(self._names(), own.tolist()):
            slack = SLACK * (abs(d) + radius)
            found = found.where((F.col(name) >= d - radius - slack) & (F.col(name) <= d + radius + slack))
        return found

    def radius(self, query: Sequence[float], k: int) -> float:
        """A distance within which ``k`` rows lie, by the cells nearest to the query; infinite if too few rows do."""
        from codequarry.operators.search import knn

        own = self.space.distances(self.space.place(np.asarray([query], np.float64)), self.pivots)[0]
        order = np.argsort(own, kind="stable").tolist()
        taken = 1
        while True:
            cells = order[:taken]
            best = knn(
                self.rows.where(F.col("cell").isin(cells)), query, k, self.space.metric, self.space.p,
                id_col=self.id_col, vec=self.vec,
            ).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
            if best.n == k:
                worst = best.low if self.space.larger_is_nearer else best.high
                return float(np.sqrt(max(2.0 - 2.0 * worst, 0.0))) if self.space.metric == "cosine" else worst
            if taken >= len(order):
                return float("inf")
            taken *= 2

    def knn(self, query: Sequence[float], k: int) -> DataFrame:
        """(id, score) of the ``k`` nearest rows, as ``search.knn`` gives them."""
        from codequarry.operators.search import knn

        rows = self.rows
        if len(query) == self.pivots.shape[1] and len(self.pivots):
            radius = self.radius(query, k)
            rows = self.near(query, radius) if np.isfinite(radius) else rows
        return knn(rows, query, k, self.space.metric, self.space.p, id_col=self.id_col, vec=self.vec)

    def skipped(self, query: Sequence[float], k: int) -> DataFrame:
        """One row: all rows of the index, and those that a search leaves unread."""
        read = self.near(query, self.radius(query, k)).agg(F.count("*")).scalar()
        return self.rows.agg(F.count("*").alias("rows")).select("rows", (F.col("rows") - read).alias("skipped"))


def build_index(
    df: DataFrame,
    path: str,
    metric: str = "l2",
    p: float = 2.0,
    pivots: int = INDEX_PIVOTS,
    id_col: str = "id",
    vec: str = "vec",
) -> PivotIndex:
    """Write ``df``'s vectors to ``path`` with their distances to pivots.

    Rows that can't have a score are left out. Distances are columns, and rows
    are sorted by cell and distance, so their ranges skip files and row groups.
    """
    space = Space(metric, p)
    if metric == "dot" or not space.bounded:
        raise ValueError("an index needs a metric: l2, cosine, or minkowski with p >= 1")
    chosen = choose_pivots(df, vec, pivots, space)
    shared = df.sparkSession.sparkContext.broadcast(chosen)  # INDEX_PIVOTS points
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, vec)}
    names = [f"d{i}" for i in range(len(chosen))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(shared.value):
                return
            rows, x = _points(batch.column(1), shared.value.shape[1], space)
            d = space.distances(x, shared.value)
            kept = batch.take(pa.array(rows))
            columns = [*kept.columns, pa.array(d.argmin(axis=1), pa.int32()), *(pa.array(c) for c in d.T)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, vec, "cell", *names])

    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kinds.items()), "cell int", *(f"{n} double" for n in names)])
    measured = df.select(id_col, vec).mapInArrow(measure, schema)
    own = F.least(*names) if len(names) > 1 else F.col(names[0]) if names else F.lit(0.0)
    placed = measured.withColumn("own", own)
    ordered = placed.repartitionByRange("cell", "own").sortWithinPartitions("cell", "own").drop("own")
    ordered.write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.schema(ordered.schema).parquet(path)
    return PivotIndex(rows, chosen, space, id_col, vec)


class _Best:
    """The best ``k`` (badness, row) of each query that one task has seen."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.worst = np.full(queries, np.inf)
        self.query = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)
        self.badness = np.zeros(0)

    def add(self, query: np.ndarray, row: np.ndarray, badness: np.ndarray) -> None:
        query, row = np.concatenate([self.query, query]), np.concatenate([self.row, row])
        badness = np.concatenate([self.badness, badness])
        order = np.lexsort((row, badness, query))
        query, row, badness = query[order], row[order], badness[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        keep = rank < self.k
        self.query, self.row, self.badness = query[keep], row[keep], badness[keep]
        last = rank == self.k - 1
        self.worst[query[last]] = badness[last]


def knn_join(
    df: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    p: float = 2.0,
    id_col: str = "id",
    vec: str = "vec",
) -> DataFrame:
    """(qid, id, score, rank): the ``k`` nearest rows to each of the queries (qid, qvec).

    Rows go to the cell of their nearest pivot. For every cell its size, its
    radii and its ``k`` least distances are known, so a query knows a distance
    within which ``k`` rows lie, and goes to the cells that can hold a nearer
    one. Under Minkowski with p < 1, which has no such bounds, all rows are one
    cell. Cells are put together in lanes, as large as a task can hold, and
    large cells are cut; queries are dealt to bands. A lane meets a band in one
    task, so a row is sent once for a band, and a query once for a lane, with
    the cells there that it must meet. Vectors of other widths than the
    pivots' have a cell for each width. The driver sees the cells only.
    """
    space = Space(metric, p)
    kernel, _ = metric_kernel(metric, p)
    sign = -1.0 if space.larger_is_nearer else 1.0
    spark = df.sparkSession
    qid_kind, id_kind = (f.schema[c].dataType.simpleString() for f, c in ((queries, "qid"), (df, id_col)))
    total = df.count()
    count = int(min(MOST_PIVOTS, max(1, -(-total // CELL_ROWS), total**0.5 / 4)))
    pivots = choose_pivots(df, vec, count, space) if space.bounded else np.zeros((0, 0))
    width = pivots.shape[1] if len(pivots) else -1
    known = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS points

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their cell (-1 - width for other widths) and the distance to its pivot."""
        for batch in _slices(batches, DEAL_ROWS):
            sizes = lengths(batch.column(1))
            for own in np.unique(sizes[sizes > 0]).tolist():
                rows, x = _points(batch.column(1), own, space)
                cell, r = np.full(len(rows), -1 - own, np.int32), np.zeros(len(rows))
                if own == width:
                    d = space.distances(x, known.value)
                    cell = d.argmin(axis=1).astype(np.int32)
                    r = d[np.arange(len(d)), cell]
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array(cell), pa.array(r)], names=["id", "x", "cell", "r"]
                )

    x_kind, q_kind = (_kept_kind(f, c) for f, c in ((df, vec), (queries, "qvec")))
    dealt = durable(
        df.select(F.col(id_col).alias("id"), F.col(vec).cast(x_kind).alias("x")).mapInArrow(
            deal, f"id {id_kind}, x {x_kind}, cell int, r double"
        )
    )
    ranked = dealt.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("r"))).where(F.col("n") <= k)
    least = ranked.groupBy("cell").agg(F.sort_array(F.collect_list("r")).alias("least"))  # k numbers a cell
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("rows"), F.max("r").alias("far"))
    cells = {row.cell: row for row in sizes.join(least, "cell").collect()}  # a row for each pivot and odd width
    table = spark.sparkContext.broadcast({c: (r.rows, r.far, r.least) for c, r in cells.items()})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the cells that they must meet."""
        inside = sorted(c for c in table.value if c >= 0)
        far = np.array([table.value[c][1] for c in inside])
        near = np.array([table.value[c][2][0] for c in inside])
        for batch in _slices(batches, DEAL_ROWS):
            sizes = lengths(batch.column(1))
            for own in np.unique(sizes[sizes > 0]).tolist():
                rows, x = _points(batch.column(1), own, space)
                if own == width and inside:
                    d = space.distances(x, known.value[inside])
                    lists = [np.array(table.value[c][2]) for c in inside]
                    slack = SLACK * (d + far)
                    if metric == "dot":
                        size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                        middle = -(x @ known.value[inside].T)
                        slack = SLACK * (np.abs(middle) + size * (far + np.abs(known.value[inside]).max()))
                        low = middle - size * far - slack
                        reach = [middle[:, [i]] + size * own_least for i, own_least in enumerate(lists)]
                    else:
                        low = np.maximum(np.maximum(d - far, near - d), 0.0) - slack
                        reach = [d[:, [i]] + own_least for i, own_least in enumerate(lists)]
                    within = np.concatenate(reach, axis=1)
                    enough = within.shape[1] >= k
                    bound = np.partition(within, k - 1, axis=1)[:, k - 1] if enough else np.full(len(x), np.inf)
                    meets = low <= (bound + slack.max(axis=1, initial=0.0))[:, None]
                    column = np.nonzero(meets)[1]
                    cell, counts = np.array(inside, np.int32)[column], meets.sum(axis=1)
                elif -1 - own in table.value:
                    cell, counts = np.full(len(rows), -1 - own, np.int32), np.ones(len(rows), np.int64)
                else:
                    continue
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, _lists(counts, cell)], names=["qid", "q", "cells"])

    asked = durable(
        queries.select("qid", F.col("qvec").cast(q_kind).alias("q")).mapInArrow(
            ask, f"qid {qid_kind}, q {q_kind}, cells array<int>"
        )
    )
    needed = {row.cell for row in asked.select(F.explode("cells").alias("cell")).distinct().collect()}
    side = int(np.ceil((2 * spark.sparkContext.defaultParallelism) ** 0.5))  # so that all tasks have work
    lanes = _lanes({c: (cells[c].rows, width if c >= 0 else -1 - c) for c in needed}, -(-total // side))
    widest = max([width, *(-1 - c for c in needed)])
    asking = asked.count()
    band = max(QUERY_ROWS, min(-(-asking // side), BAND_CELLS // max(widest, 1)))
    bands = max(1, -(-asking // band))
    routes = spark.sparkContext.broadcast(lanes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries once for every lane that has cells of theirs, with these."""
        known = np.array(sorted(routes.value), np.int32)
        many = np.array([len(routes.value[c]) for c in known.tolist()], np.int64)
        first = np.cumsum(many) - many
        flat = np.array([lane for c in known.tolist() for lane in routes.value[c]], np.int32)
        for batch in _slices(batches, DEAL_ROWS):
            met = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            query = np.repeat(np.arange(batch.num_rows), lengths(batch.column(2)))
            at = np.searchsorted(known, met)
            copy = np.repeat(np.arange(len(met)), many[at])
            inner = np.arange(len(copy)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
            lane, query, met = flat[first[at][copy] + inner], query[copy], met[copy]
            order = np.lexsort((met, lane, query))
            lane, query, met = lane[order], query[order], met[order]
            starts = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (lane[1:] != lane[:-1]))[: len(query)])
            counts = np.diff(np.append(starts, len(query)))
            longest = max(1, int(lengths(batch.column(1)).max(initial=1)))
            step = max(1, SENT_CELLS // longest)
            for start in range(0, len(starts), step):
                some = starts[start : start + step]
                kept = batch.take(pa.array(query[some]))
                own = _lists(counts[start : start + step], met[some[0] : some[-1] + counts[start : start + step][-1]])
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), own, pa.array(lane[some], pa.int32())], names=["qid", "q", "cells", "lane"]
                )

    plan = F.broadcast(spark.createDataFrame(sorted(lanes.items()), "cell int, lanes array<int>"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    own = F.get("lanes", F.pmod(F.xxhash64("id", "x"), F.size("lanes")).cast("int"))
    left = dealt.join(plan, "cell").select(own.alias("l"), every.alias("b"), "id", "x", "cell")
    right = asked.mapInArrow(send, f"qid {qid_kind}, q {q_kind}, cells array<int>, lane int")
    right = right.withColumn("band", F.pmod(F.xxhash64("qid", "q"), F.lit(bands)).cast("int"))

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = asked.schema.field("qid").type, rows.schema.field("id").type, pa.float64()
        if not len(rows) or not len(asked):
            return pa.table([pa.array([], kind) for kind in kinds], names=["qid", "id", "score"])
        ids, x, cell = (rows[c].combine_chunks() for c in ("id", "x", "cell"))
        qids, q, cells = (asked[c].combine_chunks() for c in ("qid", "q", "cells"))
        # Rows by cell, those of a cell in the order of the ids, which parts equal scores.
        rank = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        ids, cell = ids.take(pa.array(rank)), cell.to_numpy()[rank]
        by_cell = np.argsort(cell, kind="stable")
        size = int(lengths(x.slice(0, 1))[0])
        x, cell = matrix(x.take(pa.array(rank[by_cell])), size), cell[by_cell]
        found, starts = np.unique(cell, return_index=True)
        spans = list(zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(cell)]))
        # Queries that must meet the same cells are together.
        ends = np.cumsum(lengths(cells))
        met = cells.flatten().to_numpy()
        order = np.argsort(met[ends - lengths(cells)], kind="stable")
        out = []
        for start in range(0, len(order), NEAR_QUERIES):
            own = order[start : start + NEAR_QUERIES]
            y = matrix(q.take(pa.array(own)), size)
            asks = [cells[int(i)].values.to_numpy() for i in own]
            named, who = np.concatenate(asks), np.repeat(np.arange(len(own)), [len(a) for a in asks])
            best = _Best(len(own), k)
            for c, a, b in spans:
                some = who[named == c]
                for at in range(a, b if len(some) else a, NEAR_ROWS):
                    part = x[at : min(b, at + NEAR_ROWS)]
                    query, row = _close(part, y[some], best.worst[some], space, k)
                    with np.errstate(all="ignore"):
                        badness = sign * kernel(part[row], y[some[query]])
                    good = np.isfinite(badness) & (badness <= best.worst[some[query]])
                    best.add(some[query[good]], by_cell[at + row[good]], badness[good])
            columns = qids.take(pa.array(own[best.query])), ids.take(pa.array(best.row)), pa.array(sign * best.badness)
            out.append(pa.table(list(columns), names=["qid", "id", "score"]))
        return pa.concat_tables(out)

    pairs = left.groupBy("l", "b").cogroup(right.groupBy("lane", "band"))
    found = pairs.applyInArrow(meet, f"qid {qid_kind}, id {id_kind}, score double")
    best = F.desc("score") if space.larger_is_nearer else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(best, "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def _kept_kind(df: DataFrame, vec: str) -> str:
    """The type in which vectors travel: floats as they are, half as long, and all else as doubles."""
    kind = df.schema[vec].dataType.simpleString()
    return kind if kind == "array<float>" else "array<double>"


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    ends = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))


def _lanes(cells: dict[int, tuple[int, int]], share: int) -> dict[int, list[int]]:
    """The lanes of every cell, of (rows, width) each: as many rows as ``share``, but not over what a task holds.

    A cell with more rows than a lane is dealt to several; a lane has cells of one width.
    """
    lanes: dict[int, list[int]] = {}
    lane, load, last = -1, 0.0, None
    for c, (rows, width) in sorted(cells.items(), key=lambda item: (item[1][1], item[0])):
        most = max(CELL_ROWS, min(share, LANE_CELLS // width))
        parts = -(-rows // most)
        for _ in range(parts):
            if width != last or load + rows / parts > most:
                lane, load, last = lane + 1, 0.0, width
            load += rows / parts
            lanes.setdefault(c, []).append(lane)
    return {c: sorted(set(own)) for c, own in lanes.items()}


def _close(x: np.ndarray, q: np.ndarray, worst: np.ndarray, space: Space, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that may be among a query's best ``k``: a product tells most that are not."""
    if space.metric == "minkowski" and space.p != 2:
        every = np.indices((len(q), len(x))).reshape(2, -1)
        return every[0], every[1]
    with np.errstate(all="ignore"):
        products = q @ x.T
        xx, qq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)[:, None]
        if space.metric == "dot":
            rough, scale = -products, np.sqrt(qq * xx)
        elif space.metric == "cosine":
            rough, scale = -products / np.sqrt(qq * xx), np.ones_like(products)
        else:
            rough, scale = qq + xx - 2.0 * products, qq + xx
            worst = worst**2
    limit = worst[:, None]
    if len(x) > k:
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, [k - 1]])
    return np.nonzero(~(rough > limit + 1e-9 * (scale + np.where(np.isfinite(limit), np.abs(limit), 0.0))))
