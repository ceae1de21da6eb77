"""SimHash fingerprints, links within a Hamming distance, and their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import text_name, texts
from codequarry.session import durable

BITS = 64
# Fingerprints that one comparing task holds against as many others.
BLOCK = 2048


def shingle_hashes(text: str, size: int, seed: int) -> list[int]:
    """XXH64 of each shingle of ``size`` words; of all words where there are fewer.

    On bytes, ``lower`` changes A to Z only and ``split`` parts at ASCII white
    space only, which is what a word is here.
    """
    words = text.encode().lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return [digest(b" ".join(words), seed)]
    return [digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(size))))]


def majority(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give 0."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


def fingerprints(
    docs: DataFrame, shingle: int, seed: int = 42, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, fp long) of every row; NULL and texts without words have 0."""
    source = texts(docs, key, text)
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [majority(shingle_hashes(t or "", shingle, seed)) for t in batch.column(1).to_pylist()]
            signed = np.array(marks, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signed)], names=[key, "fp"]
            )

    return source.mapInArrow(run, f"`{key}` {kind}, fp long")


def segment_bounds(segments: int) -> list[int]:
    return [BITS * i // segments for i in range(segments + 1)]


def _mask(first: int, stop: int) -> int:
    """Bits ``first`` to ``stop``, counted from the low end."""
    return ((1 << stop) - 1) ^ ((1 << first) - 1)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


class Ring:
    """The segments of a fingerprint as a ring, and what a chain of them may differ by.

    Two fingerprints at distance at most ``distance`` have a segment from which
    every chain of ``l`` consecutive segments, l = 1, 2, ... m, differs in at
    most ``floor(l * distance / m)`` bits: the strong form of the pigeonhole
    principle on a ring. So the first ``exact`` segments agree entirely, and in
    those after them that allow one bit between them, one half agrees. A start
    and a half are a slot; its bits are the join key.
    """

    def __init__(self, distance: int, segments: int):
        if not 0 < distance < segments <= BITS:
            raise ValueError("distance must be positive and below the number of segments")
        self.distance, self.segments = distance, segments
        bounds = segment_bounds(segments)
        single = [_mask(a, b) for a, b in zip(bounds, bounds[1:])]
        self.budgets = [length * distance // segments for length in range(1, segments + 1)]
        self.chains = []
        for start in range(segments):
            mask, own = 0, []
            for step in range(segments):
                mask |= single[(start + step) % segments]
                own.append(mask)
            self.chains.append(own)
        exact = sum(b == 0 for b in self.budgets)
        one = sum(b == 1 for b in self.budgets)
        self.slots = []  # (start, mask of the key)
        for start in range(segments):
            base = self.chains[start][exact - 1]
            rest = [i for i in range(BITS) if (self.chains[start][exact + one - 1] ^ base) >> i & 1]
            halves = [rest[: len(rest) // 2], rest[len(rest) // 2 :]] if one else [[]]
            self.slots += [(start, base | sum(1 << i for i in half)) for half in halves]

    def linked(self, xor: np.ndarray, start: int) -> np.ndarray:
        """Pairs that keep every budget from ``start`` on, then the full distance."""
        kept = np.ones(xor.shape, bool)
        for mask, budget in zip(self.chains[start], self.budgets):
            kept &= np.bitwise_count(xor & np.uint64(mask)) <= budget
        return kept & (np.bitwise_count(xor) <= self.distance)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, ring: Ring, start: int) -> list[tuple[int, int]]:
    """Links between two blocks of one key, as few as keep connected what they connect.

    Rows of ``a`` are joined in turn to the rows of ``b`` they link to; a link
    within a set that is already joined is not listed.
    """
    parent = list(range(len(a) + (0 if same else len(b))))
    shift = 0 if same else len(a)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        hits = ring.linked(a[at : at + step, None] ^ b[None, :], start)
        for i, j in zip(*(x.tolist() for x in np.nonzero(hits))):
            x, y = root(at + i), root(j + shift)
            if x != y:
                parent[y] = x
                links.append((at + i, j))
    return links


def links(marks: DataFrame, ring: Ring) -> DataFrame:
    """(a, b) of linked fingerprints in ``marks.fp`` (distinct values), a < b or a > b.

    Not every linked pair is listed, but every two that link are connected by
    listed ones. A key shared by more than BLOCK fingerprints is cut into
    blocks, and each two blocks meet in a group of their own.
    """
    keys = F.array(
        *(
            F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
            for i, (_, mask) in enumerate(ring.slots)
        )
    )
    keyed = marks.select("fp", F.explode(keys).alias("k")).select("fp", "k.slot", "k.key")
    whole = Window.partitionBy("slot", "key")
    numbered = keyed.withColumn("n", F.count("*").over(whole)).where("n > 1")
    placed = numbered.withColumn(
        "block", ((F.row_number().over(whole.orderBy("fp")) - 1) / BLOCK).cast("int")
    )
    blocks = F.floor((F.col("n") - 1) / BLOCK).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), blocks),
        lambda other: F.struct(
            F.least(F.col("block"), other).alias("left"), F.greatest(F.col("block"), other).alias("right")
        ),
    )
    cells = placed.select("slot", "key", "block", "fp", F.explode(meets).alias("c")).select(
        "slot", "key", "c.left", "c.right", "block", "fp"
    )
    slots = ring.slots

    def compare(group: pa.Table) -> pa.Table:
        start = slots[group.column("slot")[0].as_py()][0]
        left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
        fp = group.column("fp").to_numpy()
        block = group.column("block").to_numpy()
        own = np.sort(fp[block == left])
        other = own if left == right else np.sort(fp[block == right])
        found = _forest(own.view(np.uint64), other.view(np.uint64), left == right, ring, start)
        return pa.table(
            {
                "a": pa.array([int(own[i]) for i, _ in found], pa.int64()),
                "b": pa.array([int(other[j]) for _, j in found], pa.int64()),
            }
        )

    compared = cells.groupBy("slot", "key", "left", "right").applyInArrow(compare, "a long, b long")
    return compared.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches.

    Large-star and small-star steps in turn: each hangs nodes from the least
    of their neighbours until only stars are left. The stars of every round
    are written to the shared folder.
    """
    stars = durable(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        .distinct()
    )
    seen = _state(stars)
    while True:
        both = stars.union(stars.select("root", "node").toDF("node", "root"))
        least = both.groupBy("node").agg(F.min("root").alias("low"))
        least = least.select("node", F.least("node", "low").alias("low"))
        large = (
            both.where("root > node").join(least, "node").select(F.col("root").alias("node"), "low")
        )
        large = large.where("node <> low").distinct()
        down = large.groupBy("node").agg(F.min("low").alias("least"))
        small = large.join(down, "node").select("low", "least").where("low <> least")
        stars = durable(
            small.toDF("node", "root").union(down.toDF("node", "root")).distinct()
        )
        now = _state(stars)
        if now == seen:
            return stars
        seen = now


def _state(stars: DataFrame) -> tuple:
    return tuple(
        stars.agg(
            F.count("*"),
            F.bit_xor(F.xxhash64("node", "root")),
            F.sum(F.crc32(F.concat_ws(",", "node", "root"))),
        ).first()
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int,
    distance: int,
    segments: int = 8,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, fp, component): every row with the least key its fingerprint reaches.

    Rows with equal fingerprints are one node, carried by their least key, so
    groups of copies cost one row however large they are. Keys may be of any
    type that has an order; a NULL key is not a component's name unless no
    other is there.
    """
    marks = durable(fingerprints(docs, shingle, key=key, text=text))
    nodes = durable(marks.groupBy("fp").agg(F.min(key).alias("low")))
    ring = Ring(distance, segments)
    edges = durable(links(nodes.select("fp"), ring))
    found = components(edges)
    # The component's name is its least key, not its least fingerprint.
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(names, "root").select("fp", "component")
    return marks.join(named, "fp").select(key, "fp", "component")


def keep_first(
    docs: DataFrame, shingle: int, distance: int, segments: int = 8, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each component, all columns as they are: that of the least key.

    Rows of one key are told apart by their text, then by all they hold; of
    equal rows one stays. Rows without a key have no name to choose by: they
    all stay, and a component of such rows alone loses none.
    """
    own, names = F.col(f"doc.`{key}`"), [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("doc"))
    words = F.col(f"doc.`{text}`")
    at = F.struct(
        own.isNull().alias("none"), own.alias("key"), text_name(words).alias("name"), F.xxhash64("doc").alias("rest")
    )
    rows = rows.withColumn("at", at)
    marks = near_duplicates(rows.select("at", words.alias("text")), shingle, distance, segments, "at")
    marks = durable(marks.where("NOT at.none").select("at", (F.col("at") == F.col("component")).alias("first")))
    gone = marks.where("NOT first").select("at").distinct()
    repeated = durable(marks.where("first").groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at"))
    kept = rows.join(gone, "at", "left_anti")
    once = kept.join(repeated, "at", "left_anti")
    again = kept.join(repeated, "at", "left_semi").dropDuplicates(["at"])
    return once.union(again).select("doc.*")


def hex_mark(fp: Column | str) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")
