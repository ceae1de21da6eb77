"""KMeans: all fits share every pass, and bounds skip distances that change nothing.

Rows are kept in slabs beside their state: for each fit the row's cluster, an
upper bound of its distance to that centre and a lower bound of its distance
to any other. Centres move between passes, and bounds with them; only rows
whose bounds cross are measured again. A pass sends back what changed, the
vectors that left and joined each cluster, summed in the task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.vectors import matrix
from codequarry.operators.sampling import sample_n
from codequarry.session import durable

# Numbers in a slab, passes after which lineage is cut, tasks that add up sums
# before the driver does, rows drawn for each centre of the largest fit to
# start from, and numbers in the centres of fits that share their passes.
SLAB_CELLS = 1 << 20
CUT_EVERY = 10
FAN = 8
START_ROWS = 8
CENTRE_CELLS = 1 << 22

SLABS = "rows int, x binary, state binary, change binary"


@dataclass
class Fit:
    centres: np.ndarray
    cost: float  # summed squared distance to the nearest centre
    passes: int


def slabs(points: DataFrame, vec: str) -> DataFrame:
    """Vectors of one width in slabs of about SLAB_CELLS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        cells = 0
        for batch in batches:
            if batch.num_rows:
                held.append(matrix(batch.column(0), len(batch.column(0)[0])))
                cells += held[-1].size
                if cells >= SLAB_CELLS:
                    yield _slab(np.concatenate(held))
                    held, cells = [], 0
        if held:
            yield _slab(np.concatenate(held))

    return points.select(vec).mapInArrow(run, SLABS)


def _slab(x: np.ndarray, state: bytes = b"", change: bytes = b"") -> pa.RecordBatch:
    row = [pa.array([len(x)], pa.int32()), *(pa.array([b], pa.binary()) for b in (x.tobytes(), state, change))]
    return pa.RecordBatch.from_arrays(row, names=["rows", "x", "state", "change"])


def _open(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bytes]]:
    for rows, x, state, _ in zip(*(c.to_pylist() for c in batch.columns)):
        yield np.frombuffer(x).reshape(rows, -1), state


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows to centres, close ones by differences."""
    squares = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centres, centres)
    rough = squares - 2.0 * (x @ centres.T)
    row, centre = np.nonzero(rough < 1e-6 * squares)  # few digits are left of these
    apart = x[row] - centres[centre]
    rough[row, centre] = np.einsum("ij,ij->i", apart, apart)
    return np.sqrt(rough)


class _Bounds:
    """One fit's bounds in one slab: cluster, upper and lower of every row."""

    def __init__(self, rows: int, state: np.ndarray | None):
        if state is None:
            state = np.zeros((3, rows))
            state[0], state[1] = -1.0, np.inf
        self.state = state
        self.measured = 0

    def update(self, x: np.ndarray, move: np.ndarray, centres: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Clusters as they were; the state afterwards has the clusters that are."""
        label, upper, lower = self.state
        before = label.astype(np.int64)
        far = len(move) and move.argmax()
        others = np.partition(move, -2)[-2] if len(move) > 1 else 0.0
        known = before >= 0
        upper[known] += move[before[known]]
        lower[known] -= np.where(before[known] == far, others, move[far])
        limit = np.maximum(lower, np.where(known, half[before], -np.inf))
        near = np.flatnonzero(upper * (1 + 1e-9) >= limit)
        told = near[known[near]]
        if len(told):  # the bound may just be loose
            apart = x[told] - centres[before[told]]
            upper[told] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            near = near[upper[near] * (1 + 1e-9) >= limit[near]]
        if len(near):
            gaps = _gaps(x[near], centres)
            best = gaps.argmin(axis=1)
            own = np.arange(len(near))
            label[near], upper[near] = best, gaps[own, best]
            gaps[own, best] = np.inf
            lower[near] = gaps.min(axis=1)
            self.measured += len(near)
        return before


def _changes(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> np.ndarray:
    """(k, 1 + width): rows and vectors that joined each cluster, less those that left."""
    moved = np.flatnonzero(before != after)
    out = np.zeros((k, 1 + x.shape[1]))
    for label, sign in ((after[moved], 1.0), (before[moved], -1.0)):
        real = label >= 0
        order = np.argsort(label[real], kind="stable")
        found, starts = np.unique(label[real][order], return_index=True)
        if len(found):
            rows = moved[real][order]
            out[found, 0] += sign * np.diff(np.append(starts, len(rows)))
            out[found, 1:] += sign * np.add.reduceat(x[rows], starts, axis=0)
    return out


def _add_up(sums: DataFrame, many: bool) -> np.ndarray | None:
    """The sum of a column of equally long number rows: in tasks, in FAN tasks if they are ``many``, then here."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                own = np.frombuffer(raw.as_buffer())
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    first = sums.mapInArrow(add, "sums binary")
    if many:
        part = F.pmod(F.spark_partition_id(), F.lit(FAN))
        first = first.withColumn("part", part).repartitionById(FAN, "part").select("sums").mapInArrow(add, "sums binary")
    parts = [np.frombuffer(row.sums) for row in first.collect()]
    return np.sum(parts, axis=0) if parts else None


def starts(points: DataFrame, ks: Sequence[int], seeds: Sequence[int], key: str, vec: str) -> list[np.ndarray]:
    """Rows to start from: for each fit ``k`` of a sample of START_ROWS times the largest k."""
    most = max(ks) * START_ROWS
    rows = sample_n(points.select(key, vec), most, key, min(seeds)).select(vec).collect()
    sample = np.array(sorted(list(r[0]) for r in rows), np.float64).reshape(len(rows), -1 if rows else 0)
    return [
        sample[np.random.default_rng([seed, k]).permutation(len(sample))[:k]] for k, seed in zip(ks, seeds)
    ]


def fit_all(
    points: DataFrame, begin: Sequence[np.ndarray], max_iter: int, tolerance: float, vec: str = "vec"
) -> list[Fit]:
    """Lloyd's iteration from each of ``begin``, with shared passes.

    ``points`` has vectors of one width. A fit ends when no row changes its
    cluster, or when its centres' squared moves add up to ``tolerance`` or
    less. A cluster that loses all rows keeps its centre. Fits whose centres
    have over CENTRE_CELLS numbers together are run in turn.
    """
    if not any(len(c) for c in begin):
        return [Fit(c, 0.0, 0) for c in begin]
    groups: list[list[int]] = [[]]
    cells = 0
    for i, centres in enumerate(begin):
        if groups[-1] and cells + centres.size > CENTRE_CELLS:
            groups.append([])
            cells = 0
        groups[-1].append(i)
        cells += centres.size
    held = slabs(points, vec).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = [fit for group in groups for fit in _fit_group(held, [begin[i] for i in group], max_iter, tolerance)]
    finally:
        held.unpersist()
    return found


def _fit_group(held: DataFrame, begin: list[np.ndarray], max_iter: int, tolerance: float) -> list[Fit]:
    context = held.sparkSession.sparkContext
    centres = [np.array(c, np.float64) for c in begin]
    sums = [np.zeros((len(c), 1 + c.shape[1])) for c in centres]
    moves = [np.zeros(len(c)) for c in centres]
    passes = [0] * len(centres)
    active = list(range(len(centres)))
    many = held.rdd.getNumPartitions() > FAN * FAN
    state, known = held, False
    for number in range(1, max_iter + 1):
        half = []
        for c in centres:
            gaps = _gaps(c, c)
            np.fill_diagonal(gaps, np.inf)
            half.append(gaps.min(axis=1, initial=np.inf) / 2)
        shared = context.broadcast((centres, moves, half, active))  # CENTRE_CELLS numbers or so

        def step(batches, shared=shared, known=known) -> Iterator[pa.RecordBatch]:
            centres, moves, half, active = shared.value
            for batch in batches:
                for x, raw in _open(batch):
                    old = np.frombuffer(raw).reshape(len(centres), 3, len(x)).copy() if known else None
                    new, change = [], []
                    for f, c in enumerate(centres):
                        own = _Bounds(len(x), None if old is None else old[f])
                        if f in active:
                            before = own.update(x, moves[f], c, half[f])
                            change.append(_changes(x, before, own.state[0].astype(np.int64), len(c)))
                        new.append(own.state)
                    flat = np.concatenate([c.ravel() for c in change])
                    yield _slab(x, np.stack(new).tobytes(), flat.tobytes())

        after = state.mapInArrow(step, SLABS)
        if number % CUT_EVERY:
            after = after.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            after = durable(after)
        total = _add_up(after.select("change"), many)
        if known:
            state.unpersist()
        state, known = after, True
        if total is None:  # no rows
            break
        at, still = 0, []
        for f in active:
            change = total[at : at + sums[f].size].reshape(sums[f].shape)
            at += sums[f].size
            sums[f] += change
            passes[f] = number
            rows = np.round(sums[f][:, :1])
            fresh = np.where(rows > 0, sums[f][:, 1:] / np.maximum(rows, 1), centres[f])
            moves[f] = np.sqrt(((fresh - centres[f]) ** 2).sum(axis=1))
            centres[f] = fresh
            if change.any() and (moves[f] ** 2).sum() > tolerance:
                still.append(f)
        active = still
        if not active:
            break
    if known:
        state.unpersist()
    return [Fit(c, cost, n) for c, cost, n in zip(centres, _costs(held, centres, many), passes)]


def _costs(held: DataFrame, centres: list[np.ndarray], many: bool) -> list[float]:
    shared = held.sparkSession.sparkContext.broadcast(centres)  # CENTRE_CELLS numbers or so

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value))
        for batch in batches:
            for x, _ in _open(batch):
                for f, c in enumerate(shared.value):
                    total[f] += (_gaps(x, c).min(axis=1) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = _add_up(held.mapInArrow(measure, "sums binary"), many)
    return [0.0] * len(centres) if found is None else found.tolist()
