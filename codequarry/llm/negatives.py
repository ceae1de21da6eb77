"""Hard negatives from blocks in the order of a Hilbert curve, with zone maps.

Vectors of whole numbers are sorted along the curve and written as Parquet
rows that hold a block each, beside the least and greatest value of every
dimension. Interval arithmetic on these gives the scores that a block can
hold for an anchor, and so which blocks its windows must read. Anchors travel
in tiles, blocks in lanes; a lane meets a band of tiles in one task, and what
leaves it are the best few rows of each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import durable, scratch_path

# Rows of a block, anchors of a tile, blocks that meet so many tiles in one task.
BLOCK_ROWS = 512
TILE_ANCHORS = 256
LANE_BLOCKS = 32
BAND_TILES = 16
# Bits of each dimension in a row's place on the curve.
CURVE_BITS = 4
# Sums of whole numbers below this are exact in floating point.
EXACT = 2.0**52

LEAST, MOST = -(1 << 63), (1 << 63) - 1
BLOCKS = "block long, width int, ids array<long>, labels array<long>, anchors array<boolean>, q binary, "
BLOCKS += "low binary, high binary, kinds array<long>"
ASKED = "array<struct<row: int, slot: int, low: long, high: long>>"
TILES = f"tile long, width int, uids array<long>, ids array<long>, labels array<long>, q binary, asked {ASKED}"


def curve_places(cells: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """The place of each row of ``cells``, whole numbers below 2**bits, on the Hilbert curve.

    Bit by bit from the highest, the cell's corner is reflected and turned the
    way the curve enters it; a Gray code of what is left is the place.
    """
    n, width = cells.shape
    if not width:
        return [b""] * n
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    for bit in range(bits - 1, 0, -1):
        below = np.uint32((1 << bit) - 1)
        for i in range(width):
            upper = (x[i] >> np.uint32(bit)) & np.uint32(1) == 1
            swap = np.where(upper, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(upper, below, swap)
            x[i] ^= swap
    for i in range(1, width):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(bit)) & np.uint32(1) == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turn
    levels = [(x >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(levels).T.astype(np.uint8), axis=1)]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers, exact; a score beyond 64 bits is an error."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if most * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.array((a.astype(object) @ b.astype(object).T).tolist(), np.int64).reshape(len(a), len(b))


def _matrix(raw: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(rows, width)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def write_blocks(rows: DataFrame, path: str) -> DataFrame:
    """The rows (id, label, anchor, q) in blocks along the curve, written to ``path``.

    ``q`` are whole numbers. A block holds vectors of one width, since only
    those have a product.
    """
    spread = rows.select(F.posexplode("q").alias("i", "x")).groupBy("i")
    ends = spread.agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i").collect()  # a row a dimension
    low = np.array([r.low for r in ends], np.float64)
    span = np.maximum(np.array([r.high for r in ends], np.float64) - low, 1.0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(3)
            widths = q.value_lengths().to_numpy()
            flat, offsets = q.values.to_numpy(), q.offsets.to_numpy()
            places: list = [None] * batch.num_rows
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                x = flat[offsets[at][:, None] + np.arange(width)]
                top = 1 << CURVE_BITS
                cells = np.clip((x - low[:width]) / span[:width] * top, 0, top - 1)
                for i, where in zip(at.tolist(), curve_places(cells)):
                    places[i] = where
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(widths, pa.int32()), pa.array(places, pa.binary())],
                names=["id", "label", "anchor", "q", "width", "place"],
            )

    schema = "id long, label long, anchor boolean, q array<long>, width int, place binary"
    placed = rows.select("id", F.col("label").cast("long").alias("label"), "anchor", "q").mapInArrow(place, schema)
    ordered = placed.repartitionByRange("width", "place", "id").sortWithinPartitions("width", "place", "id")

    def block(number: int, width: int, held: list[tuple]) -> pa.RecordBatch:
        ids, labels, anchors, q = (list(x) for x in zip(*held))
        own = np.array(q, "<i8").reshape(len(q), width)
        kinds = sorted(set(labels))
        row = [number, width, ids, labels, anchors, own.tobytes()]
        row += [own.min(axis=0).tobytes(), own.max(axis=0).tobytes(), kinds]
        longs = pa.list_(pa.int64())
        types = pa.int64(), pa.int32(), longs, longs, pa.list_(pa.bool_()), *[pa.binary()] * 3, longs
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, types)],
            names=["block", "width", "ids", "labels", "anchors", "q", "low", "high", "kinds"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _task() << 32
        held: list[tuple] = []
        width, number = -1, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for id_, label, anchor, q, own in zip(*columns):
                if held and (own != width or len(held) >= BLOCK_ROWS):
                    yield block(first + number, width, held)
                    held, number = [], number + 1
                width = own
                held.append((id_, label, anchor, q))
        if held:
            yield block(first + number, width, held)

    ordered.mapInArrow(blocks, BLOCKS).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(BLOCKS).parquet(path)


def anchor_tiles(blocks: DataFrame, k: int) -> DataFrame:
    """Anchors in tiles, along the curve, each asking for its ``k`` best rows of its label.

    What the anchor's own block holds is read here, so an anchor asks for no
    less than the ``k``-th best of that.
    """

    def tile(number: int, width: int, held: list[tuple]) -> pa.RecordBatch:
        uids, ids, labels, q, lows = (list(x) for x in zip(*held))
        asked = [{"row": i, "slot": 0, "low": low, "high": MOST} for i, low in enumerate(lows)]
        row = [number, width, uids, ids, labels, np.array(q, "<i8").tobytes(), asked]
        longs = pa.list_(pa.int64())
        asks = pa.struct([("row", pa.int32()), ("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
        types = pa.int64(), pa.int32(), longs, longs, longs, pa.binary(), pa.list_(asks)
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, types)],
            names=["tile", "width", "uids", "ids", "labels", "q", "asked"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _task() << 32
        held: list[tuple] = []
        width, number = -1, 0
        for batch in batches:
            for row in batch.to_pylist():
                at = np.flatnonzero(row["anchors"])
                if not len(at):
                    continue
                q = _matrix(row["q"], row["width"], len(row["ids"]))
                labels = np.array(row["labels"], np.int64)
                scores = _products(q[at], q)
                for i, own in zip(at.tolist(), scores):
                    same = labels == labels[i]
                    same[i] = False
                    others = own[same]
                    low = int(np.partition(others, -k)[-k]) if len(others) >= k else LEAST
                    if held and (row["width"] != width or len(held) >= TILE_ANCHORS):
                        yield tile(first + number, width, held)
                        held, number = [], number + 1
                    width = row["width"]
                    uid = row["block"] * BLOCK_ROWS + i
                    held.append((uid, row["ids"][i], row["labels"][i], q[i], low))
        if held:
            yield tile(first + number, width, held)

    return blocks.select("block", "width", "ids", "labels", "anchors", "q").mapInArrow(run, TILES)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) product of each anchor with any vector between ``low`` and ``high``."""
    a, low, high = (x.astype(np.float64) for x in (anchors, low, high))
    up, down = np.maximum(a, 0.0), np.minimum(a, 0.0)
    slack = 1e-12 * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _asked(tile: dict) -> dict[str, np.ndarray]:
    asked = tile["asked"]
    return {name: np.array([x[name] for x in asked], np.int64) for name in ("row", "slot", "low", "high")}


def plan_reads(blocks: DataFrame, tiles: DataFrame, same: bool, lanes: int, bands: int) -> DataFrame:
    """(lane, band, tile, reads): the blocks that a tile must read, and which of its windows must.

    Told by the zone maps alone: a block may hold a score of the window, and a
    row of the anchor's label (or, unless ``same``, of another).
    """
    zones = blocks.select("block", "width", "low", "high", "kinds", _dealt("block", lanes).alias("lane"))
    zones = zones.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    asking = tiles.select("tile", "width", "labels", "q", "asked", _dealt("tile", bands).alias("band"))
    asking = asking.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    reads = pa.list_(pa.struct([("block", pa.int64()), ("windows", pa.binary())]))
    names = ["lane", "band", "tile", "reads"]

    def choose(key: tuple, zone: pa.Table, tile: pa.Table) -> pa.Table:
        out = []
        there = zone.to_pylist()
        for t in tile.to_pylist():
            near = [z for z in there if z["width"] == t["width"]]
            if not near:
                continue
            labels = np.array(t["labels"], np.int64)
            a = _matrix(t["q"], t["width"], len(labels))
            low, high = (np.stack([np.frombuffer(z[c], "<i8") for z in near]) for c in ("low", "high"))
            least, most = bounds(a, low, high)
            has = np.stack([np.isin(labels, z["kinds"]) for z in near], axis=1)
            if not same:
                has = np.array([len(z["kinds"]) for z in near]) > has
            asked = _asked(t)
            own = asked["row"]
            wanted = has[own] & (most[own] >= asked["low"][:, None]) & (least[own] <= asked["high"][:, None])
            order = np.argsort(-most.max(axis=0), kind="stable")
            chosen = [
                {"block": near[b]["block"], "windows": np.packbits(wanted[:, b]).tobytes()}
                for b in order.tolist()
                if wanted[:, b].any()
            ]
            if chosen:
                out.append((key[0].as_py(), key[1].as_py(), t["tile"], chosen))
        columns = list(zip(*out)) or [[]] * 4
        kinds = pa.int32(), pa.int32(), pa.int64(), reads
        return pa.table([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=names)

    pairs = zones.groupBy("lane", "band").cogroup(asking.groupBy("lane", "band"))
    return pairs.applyInArrow(
        choose, "lane int, band int, tile long, reads array<struct<block: long, windows: binary>>"
    )


def _dealt(number: str, ways: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(ways)).cast("int")


class _Best:
    """The best ``k`` (score, id) of each window that one task has seen."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.least = np.full(windows, LEAST)
        self.held = np.zeros((4, 0), np.int64)  # window, score, id, uid

    def add(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray, uid: np.ndarray) -> None:
        every = np.concatenate([self.held, np.stack([window, score, id_, uid])], axis=1)
        every = every[:, np.lexsort((every[3], every[2], ~every[1], every[0]))]
        starts = np.searchsorted(every[0], every[0], "left")
        rank = np.arange(every.shape[1]) - starts
        self.held = every[:, rank < self.k]
        last = rank == self.k - 1
        self.least[every[0, last]] = every[1, last]


def best_rows(blocks: DataFrame, tiles: DataFrame, same: bool, k: int, lanes: int, bands: int) -> DataFrame:
    """(tile, row, slot, rank, anchor, id, score): the best ``k`` rows in each window that tiles ask for.

    Rows are of the anchor's label, itself left out, or else of other labels.
    Ties go to the smaller id.
    """
    reads = durable(plan_reads(blocks, tiles, same, lanes, bands))
    needed = reads.select(
        F.col("lane").alias("aisle"), F.col("band").alias("line"), F.explode("reads.block").alias("block")
    ).distinct()
    shelves = blocks.select("block", "width", "ids", "labels", "q").join(needed, "block")
    asking = tiles.join(reads, "tile")
    names = ["tile", "row", "slot", "anchor", "id", "uid", "score"]
    kinds = pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4

    def search(shelf: pa.Table, tile: pa.Table) -> pa.Table:
        at = {b: i for i, b in enumerate(shelf["block"].to_pylist())}
        found = []
        for t in tile.to_pylist():
            asked, labels = _asked(t), np.array(t["labels"], np.int64)
            uids, ids = np.array(t["uids"], np.int64), np.array(t["ids"], np.int64)
            a = _matrix(t["q"], t["width"], len(labels))
            best = _Best(len(asked["row"]), k)
            for read in t["reads"]:
                i = at[read["block"]]
                own_ids = shelf["ids"][i].values.to_numpy()
                own_labels = shelf["labels"][i].values.to_numpy()
                own_uids = read["block"] * BLOCK_ROWS + np.arange(len(own_ids))
                windows = np.flatnonzero(np.unpackbits(np.frombuffer(read["windows"], np.uint8))[: len(best.least)])
                rows, back = np.unique(asked["row"][windows], return_inverse=True)
                q = _matrix(shelf["q"][i].as_py(), t["width"], len(own_ids))
                fits = own_labels == labels[rows][:, None]
                fits = fits & (own_uids != uids[rows][:, None]) if same else ~fits
                scores, fits = _products(a[rows], q)[back], fits[back]
                low = np.maximum(asked["low"][windows], best.least[windows])[:, None]
                fits &= (scores >= low) & (scores <= asked["high"][windows][:, None])
                of, column = np.nonzero(fits)
                if len(of):
                    best.add(windows[of], scores[of, column], own_ids[column], own_uids[column])
            window, score, id_, uid = best.held
            row = asked["row"][window]
            found.append([np.full(len(row), t["tile"]), row, asked["slot"][window], ids[row], id_, uid, score])
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * len(names)
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    pairs = shelves.groupBy("aisle", "line").cogroup(asking.groupBy("lane", "band"))
    near = pairs.applyInArrow(
        search, "tile long, row int, slot int, anchor long, id long, uid long, score long"
    )
    order = Window.partitionBy("tile", "row", "slot").orderBy(F.desc("score"), "id", "uid")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("uid")


def whole_numbers(vec: str, scale: int) -> Column:
    """floor(scale * x) of each number; NULL if there is none, or any is NULL or not finite."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(vec, lambda x: F.floor(x.cast("double") * scale)))


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
    scale: int = 256,
    key: str = "vec_id",
    vec: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that ``anchor`` marks its best ``positives`` other rows of one
    label, and for each of those the best ``negatives`` rows of other labels
    that score between ``percent`` of it. Scores are products of whole numbers,
    floor(scale * x); ties go to the smaller key. Rows take no part that lack
    a key, a label or a vector, or have a number that is NULL or not finite;
    only vectors of one width meet. Repeated rows are rows of their own. A
    positive score below 0 leaves no window, and one of 0 that of 0 alone.
    """
    spark = rows.sparkSession
    used = rows.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), whole_numbers(vec, scale).alias("q"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    blocks = write_blocks(used, scratch_path(spark, "blocks"))
    tiles = durable(anchor_tiles(blocks, positives))
    lanes, bands = (max(1, -(-df.count() // n)) for df, n in ((blocks, LANE_BLOCKS), (tiles, BAND_TILES)))
    found = durable(best_rows(blocks, tiles, True, positives, lanes, bands))
    near, far = (F.expr(x) for x in (
        f"cast((cast(score as decimal(20,0)) * {percent[0]} + 99) div 100 as bigint)",
        f"cast((cast(score as decimal(20,0)) * {percent[1]}) div 100 as bigint)",
    ))
    windows = found.where("score >= 0").select(
        "tile", F.struct("row", F.col("rank").alias("slot"), near.alias("low"), far.alias("high")).alias("w")
    )
    asked = windows.groupBy("tile").agg(F.collect_list("w").alias("asked"))  # at most TILE_ANCHORS * positives
    asking = durable(tiles.drop("asked").join(asked, "tile"))
    chosen = best_rows(blocks, asking, False, negatives, lanes, bands).select(
        "tile", "row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    own = found.select(
        "tile", "row", F.col("rank").alias("slot"), F.col("anchor").alias("anchor_id"),
        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return own.join(chosen, ["tile", "row", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
