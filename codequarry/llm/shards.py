"""Shards of near equal bytes by a k-d tree over what is known of each text.

A cell of the tree is split along the dimension in which it is widest, at the
weighted median of its rows, until every leaf is one shard. Medians are found
by counting: a pass bins a cell's rows, keeps the bin in which the median
lies, and the next pass bins what is in it. All cells of a level share their
passes, which read a narrow table; texts move once, when the shards are
written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import durable

# Bins of a pass, for each cell that is being split.
BINS = 1 << 12
# Bytes of text that one writing task is to have.
SLICE_BYTES = 64 << 20
# Share of a shard's target up to which rows of one coordinate, and copies of
# one text, stay on one side of a cut.
WHOLE = 1 / 100
# Spark numbers rows within a partition in the low bits, partitions above them.
ROW_BITS = 33

DIGEST, TURN = "__digest", "__turn"


def text_dimensions(text: str = "text") -> dict[str, Column]:
    """Dimensions that copies of a text share, as whole numbers from 0 on."""
    t = F.coalesce(F.col(text), F.lit(""))
    return {
        "bytes": F.octet_length(t).cast("long"),
        "characters": F.length(t).cast("long"),
        "spaces": (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("long"),
        "lines": (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long"),
    }


def byte_size(text: Column) -> Column:
    """What a row weighs: the bytes of its text, and one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


@dataclass
class Node:
    """A cell: the shards in it, and where it is cut.

    ``cut`` is [(column, value), …]: a row goes left if it comes before these
    values, compared one after the other.
    """

    first: int
    shards: int
    cut: list[tuple[str, int]] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> Iterator[Node]:
        if self.left is None:
            yield self
        else:
            yield from self.left.leaves()
            yield from self.right.leaves()

    def shard(self) -> Column:
        """The first shard of the leaf that a row falls in."""
        if self.left is None:
            return F.lit(self.first)
        before = F.lit(False)
        for column, value in reversed(self.cut):
            before = (F.col(column) < value) | ((F.col(column) == value) & before)
        return F.when(before, self.left.shard()).otherwise(self.right.shard())


@dataclass
class _Median:
    """The search for one cell's cut: which keys are settled, and where the next one lies."""

    node: Node
    keys: list[str]
    target: float  # bytes that should go left
    low: int
    high: int
    settled: list[tuple[str, int]] = field(default_factory=list)
    before: int = 0  # bytes of rows below the range

    def inside(self) -> Column:
        here = F.col("__cell") == self.node.first
        for column, value in self.settled:
            here &= F.col(column) == value
        own = F.col(self.keys[0])
        return here & (own >= self.low) & (own <= self.high)

    def bin(self) -> Column:
        step = (self.high - self.low) // BINS + 1
        return F.floor((F.col(self.keys[0]) - F.lit(self.low)) / F.lit(step)).cast("int")

    def narrow(self, rows: list, whole: float) -> bool:
        """Take the bins that were counted; true when the cut is found."""
        for row in rows:  # in order
            if self.before + row.weight >= self.target:
                break
            self.before += row.weight
        else:  # rounding: all is left of the median
            self.before -= row.weight
        if row.low < row.high:
            self.low, self.high = row.low, row.high
            return False
        if row.weight > whole and len(self.keys) > 1:
            self.settled.append((self.keys.pop(0), row.low))
            self.low, self.high = 0, (1 << 62) - 1
            return False
        after = self.before + row.weight
        right = after - self.target < self.target - self.before  # the nearer edge
        self.node.cut = [*self.settled, (self.keys[0], row.low + right)]
        return True


def grow(points: DataFrame, dims: list[str], shards: int) -> Node:
    """The tree of rows (weight, dimensions, digest, turn).

    The driver sees the extents of each cell and at most BINS counts for each
    cell that is being split. Rows of one coordinate are parted by the text's
    hash only if they weigh more than WHOLE of a shard, and copies of one text
    by the hash of their keys only if they do; so a tree is the same however
    the rows are dealt.
    """
    root = Node(0, shards)
    spread: dict[str, int] = {}
    total = 0
    while True:
        cells = {n.first: n for n in root.leaves() if n.shards > 1}
        if not cells:
            return root
        placed = points.withColumn("__cell", root.shard())
        ends = [f(d).alias(f"{d} {n}") for d in dims for f, n in ((F.min, "low"), (F.max, "high"))]
        found = placed.groupBy("__cell").agg(F.sum("weight").alias("weight"), *ends).collect()
        if not spread:
            total = sum(row.weight for row in found)
            spread = {d: max([1, *(r[f"{d} high"] - r[f"{d} low"] for r in found)]) for d in dims}
        searches = []
        for node in cells.values():
            half = node.shards // 2
            node.left, node.right = Node(node.first, half), Node(node.first + half, node.shards - half)
            node.cut = [(DIGEST, 0)]  # a cell without rows
        for row in found:
            node = cells.get(row["__cell"])
            if node is not None:
                widest = max(dims, key=lambda d: (row[f"{d} high"] - row[f"{d} low"]) / spread[d])
                target = row.weight * node.left.shards / node.shards
                keys = [widest, DIGEST, TURN]
                searches.append(_Median(node, keys, target, row[f"{widest} low"], row[f"{widest} high"]))
        while searches:
            which = bins = F.lit(None).cast("int")
            for search in searches:
                here = search.inside()
                which = F.when(here, F.lit(search.node.first)).otherwise(which)
                bins = F.when(here, search.bin()).otherwise(bins)
            own = F.lit(None).cast("long")
            for search in searches:
                own = F.when(F.col("__which") == search.node.first, F.col(search.keys[0])).otherwise(own)
            counts = (
                placed.withColumn("__which", which)
                .withColumn("__bin", bins)
                .where("__which IS NOT NULL")
                .withColumn("__own", own)
                .groupBy("__which", "__bin")
                .agg(F.sum("weight").alias("weight"), F.min("__own").alias("low"), F.max("__own").alias("high"))
                .collect()
            )
            by_cell: dict[int, list] = {}
            for row in sorted(counts, key=lambda r: (r["__which"], r["__bin"])):
                by_cell.setdefault(row["__which"], []).append(row)
            whole = WHOLE * total / shards
            searches = [s for s in searches if not s.narrow(by_cell[s.node.first], whole)]


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int | None = None,
    target_bytes: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    dims: dict[str, Column] | None = None,
) -> None:
    """Write all rows of ``docs`` into folders ``shard=0`` and so on.

    A shard is written in slices of about SLICE_BYTES, to which the hash of
    the key deals its rows, so no task has much more than another; a slice is
    in key order.

    Give the number of shards, or the bytes that each should have. ``dims``
    names whole numbers from 0 on (see ``text_dimensions``). A NULL text
    weighs one byte, like an empty one; NULL keys come first. Rows that agree
    in key and text are never parted. A file row is (weight, at, doc) with all
    columns of ``docs`` in ``doc``, so names cannot clash. An empty table has
    no folders.
    """
    dims = text_dimensions(text) if dims is None else dims
    own = {f"__{name}": column for name, column in dims.items()}
    words = F.coalesce(F.col(text), F.lit(""))
    hashes = {
        DIGEST: F.shiftrightunsigned(F.xxhash64(words), 2),
        TURN: F.shiftrightunsigned(F.xxhash64(F.col(key)), 2),
    }
    columns = {"weight": byte_size(F.col(text)), **own, **hashes}
    points = durable(docs.select(*(c.alias(n) for n, c in columns.items())))
    total = points.agg(F.sum("weight")).first()[0] or 0
    if shards is None:
        shards = max(1, round(total / target_bytes))
    slices = max(1, -(-total // (shards * SLICE_BYTES)))
    tree = grow(points, list(own), shards)
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.col(key).alias("__key"),
        *(c.alias(n) for n, c in columns.items()),
    )
    placed = whole.withColumn("shard", tree.shard().cast("int")).select("shard", "weight", "doc", "__key", DIGEST, TURN)
    task = (F.col("shard") * F.lit(slices) + F.pmod(TURN, F.lit(slices))).cast("int")
    dealt = placed.withColumn("__task", task).repartitionById(shards * slices, "__task")
    ordered = dealt.sortWithinPartitions("__key", DIGEST)
    files = ordered.select("shard", "weight", F.monotonically_increasing_id().alias("at"), "doc")
    files.write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(like: DataFrame, path: str) -> DataFrame:
    """(shard, slot, weight, doc) of the files at ``path``, written from rows like ``like``.

    Slots count the rows of a shard from 0. A writing task left consecutive
    rows of one shard, so what it adds is the number of rows that earlier tasks
    left there: one figure for each task and shard it met.
    """
    spark = like.sparkSession
    doc = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in like.schema.fields)
    schema = f"weight long, at long, doc struct<{doc}>, shard int"
    files = spark.read.schema(schema).parquet(path).withColumn("part", F.shiftright("at", ROW_BITS))
    runs = files.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select(
        "shard", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("base")
    )
    # As many rows as writing tasks and shards together.
    rows = files.join(F.broadcast(bases), ["shard", "part"])
    return rows.select("shard", (F.col("at") + F.col("base")).alias("slot"), "weight", "doc")
