"""Repeated passages by merging Burrows-Wheeler transforms.

A passage of ``span`` bytes has an anchor: of its runs of GRAM bytes the one
with the least hash, the first of equals. Equal passages have equal anchors,
at the same distance from their start, so anchors that stand once in the
corpus have no repeated passage, and the others part the corpus into families
that can be searched apart. An anchor's context is all text of the
consecutive passages that it is the anchor of.

Within a family, contexts are cut into shards; each shard gets its
Burrows-Wheeler transform, and the transforms are merged by refining the
order in which they interleave, up to forty bytes a step. What is still together
after ``span`` bytes is an interval of the merged suffix array with a common
prefix of ``span`` bytes: the starts of repeated passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import text_name, texts
from codequarry.session import durable

GRAM = 32
# Bytes whose anchors are looked for at a time.
CHUNK = 1 << 20
# Bits of the filters that tell tasks which anchors, and which texts, to look at.
FILTER_BITS = 1 << 26
# Contexts of one family that meet in one task.
FAMILY = 4000
# Bytes whose transforms are merged at a time, and into how many shards they are cut.
MERGED_BYTES = 60_000
SHARDS = 4
# Symbols that are read as one 64-bit number, and that one step of a merge takes at most.
WIDEST = 8
STRIDE = 40
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` bytes; ``size`` is a power of two."""
    h, length = raw.astype(np.uint64) + np.uint64(1), 1
    while length < size:
        n = len(h) - length
        h = h[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + h[length:]
        length *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    least, length = values, 1
    while 2 * length <= width:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    rest = width - length
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(text: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) for each run of passages with one anchor.

    A passage's anchor depends on the passage alone.
    """
    hashes, firsts, lasts = [], [], []
    total = len(text) - span + 1  # passages
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, max(total, 0), CHUNK):
        count = min(CHUNK, total - at)
        h = gram_hashes(raw[at : at + count + span - 1], GRAM)
        place = np.arange(len(h), dtype=np.uint64)
        marked = (h & ~np.uint64((1 << 22) - 1)) | place
        chosen = (sliding_min(marked, span - GRAM + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        hashes.append(h[chosen[begin]])
        firsts.append(begin + at)
        lasts.append(np.concatenate((begin[1:], [count])) - 1 + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def name_of(data: bytes) -> bytes:
    """128 bits that name a text or a context."""
    return hashlib.blake2b(data, digest_size=16).digest()


class Filter:
    """A set of 64-bit values, of fixed size: it may hold more than was put in, never less."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, values: np.ndarray) -> np.ndarray:
        bit = values & np.uint64(FILTER_BITS - 1)
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def make_filter(values: DataFrame, column: str) -> Filter:
    """The filter of a column of 64-bit values; Spark sets the bits, the driver gets 8 MB."""
    bits = values.select(F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit"))
    found = (
        bits.groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(words)


def codes(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` symbols from each place of a cyclic text on, as one number that keeps their order."""
    found = data.astype(np.uint64)
    for step in range(1, width):
        found = (found << np.uint64(8)) | np.roll(data, -step).astype(np.uint64)
    return found


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each place of a cyclic text by its first ``depth`` symbols or more; equals share one."""
    length = WIDEST
    distinct, rank = np.unique(codes(data, length), return_inverse=True)
    while length < depth and len(distinct) < len(data):
        distinct, rank = np.unique(rank * len(distinct) + np.roll(rank, -length), return_inverse=True)
        length *= 2
    return rank


class Shard:
    """The Burrows-Wheeler transform of some contexts, each ended by a 0. Symbols are numbers from 1 to 255."""

    def __init__(self, contexts: list[np.ndarray], depth: int):
        self.data = np.concatenate([np.append(c, 0) for c in contexts]).astype(np.uint8)
        self.order = np.argsort(suffix_ranks(self.data, depth), kind="stable")
        self.rank = np.empty(len(self.order), np.int64)
        self.rank[self.order] = np.arange(len(self.order))

    def before(self, width: int) -> np.ndarray:
        """For each suffix in order the place ``width`` symbols before it."""
        return (self.order - width) % len(self.order)


def symbol_numbers(shards: list[Shard], width: int) -> tuple[np.ndarray, int]:
    """The ``width`` symbols from each place on, numbered in their order over all shards, and how many there are."""
    base = np.cumsum([0] + [len(s.data) for s in shards])

    def after(distance: int) -> np.ndarray:
        return np.concatenate([b + (np.arange(len(s.data)) + distance) % len(s.data) for s, b in zip(shards, base)])

    have = min(width, WIDEST)
    distinct, number = np.unique(np.concatenate([codes(s.data, have) for s in shards]), return_inverse=True)
    known = {have: number}
    while have < width:
        more = max(w for w in known if have + w <= width)
        distinct, number = np.unique(number * len(distinct) + known[more][after(have)], return_inverse=True)
        have += more
        known[have] = number
    return number, len(distinct)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of all suffixes and where its intervals begin.

    ``order`` holds places in the shards' transforms, one shard after the
    other. Each step puts before every suffix the symbols that precede it: a
    stable sort by them of the present order, in which suffixes keep their
    turn, gives the order by so many symbols more. Suffixes share an interval
    as long as all symbols so far agree, so the intervals left at the end have
    a common prefix of ``depth``. No suffix is compared with another. A step
    takes as many symbols as divide ``depth`` and make at most 65,536
    different strings, numbered in their order; one symbol always does.
    """
    base = np.cumsum([0] + [len(s.order) for s in shards])
    for width in (w for w in range(STRIDE, 0, -1) if depth % w == 0 and (w <= WIDEST or w % WIDEST == 0)):
        number, different = symbol_numbers(shards, width)
        if different <= 1 << 16:
            break
    places = [s.before(width) for s in shards]
    symbols = np.concatenate([number[b : b + len(p)][p] for p, b in zip(places, base)]).astype(np.uint16)
    back = np.concatenate([s.rank[p] + b for s, p, b in zip(shards, places, base)]).astype(np.int32)
    order = np.arange(len(symbols), dtype=np.int32)
    interval = np.zeros(len(symbols), np.int32)
    for _ in range(depth // width):
        before = symbols[order]
        turn = np.argsort(before, kind="stable")
        symbol, own = before[turn], interval[turn]
        opens = np.empty(len(turn), bool)
        opens[0] = True
        np.logical_or(symbol[1:] != symbol[:-1], own[1:] != own[:-1], out=opens[1:])
        interval = np.cumsum(opens, dtype=np.int32)
        order = back[order[turn]]
    return order, interval


def repeated_starts(
    contexts: list[bytes], starts: list[int], weights: list[int], span: int
) -> list[np.ndarray]:
    """For each context, which of its first ``starts`` passages occur more than once.

    ``weights`` say how often a context itself occurs.
    """
    used = np.unique(np.frombuffer(b"".join(contexts), np.uint8))
    number = np.zeros(256, np.int64)  # UTF-8 has fewer than 255 different bytes
    number[used] = np.arange(1, len(used) + 1)
    parts = [[] for _ in range(min(SHARDS, len(contexts)))]
    for i in range(len(contexts)):
        parts[i % len(parts)].append(i)
    shards, owner, offset = [], [], []
    for part in parts:
        own = [number[np.frombuffer(contexts[i], np.uint8)] for i in part]
        shard = Shard(own, span)
        who = np.repeat(part, [len(c) + 1 for c in own])
        where = np.concatenate([np.arange(len(c) + 1) for c in own])
        shards.append(shard)
        owner.append(who[shard.order])
        offset.append(where[shard.order])
    order, interval = merge(shards, span)
    who, where = np.concatenate(owner)[order], np.concatenate(offset)[order]
    real = where < np.array(starts)[who]
    who, where, interval = who[real], where[real], interval[real]
    weight = np.bincount(interval, np.array(weights)[who])
    hit = weight[interval] > 1
    out = [np.zeros(n, bool) for n in starts]
    by = np.argsort(who[hit], kind="stable")
    who, where = who[hit][by], where[hit][by]
    cuts = np.searchsorted(who, np.arange(len(contexts) + 1))
    for i, flags in enumerate(out):
        flags[where[cuts[i] : cuts[i + 1]]] = True
    return out


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(first, last) of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges.reshape(-1, 2) - (0, 1)


def _scan(docs: DataFrame, span: int, wanted: Filter | None, contexts: bool) -> DataFrame:
    """What the texts of ``docs`` (text, name) have at their anchors.

    Without a filter (h, n): how often each anchor stands in a batch of texts.
    With one, for its anchors only: (name, h, context, count, firsts), where the
    context begins and how many passages it has; or (h, context, count, at,
    body) with the context itself and the anchor's place in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [anchors(t.encode(), span)[0] for t in batch.column(0).to_pylist()]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"]
            )

    def each(text: bytes) -> Iterator[tuple[int, int, int]]:
        h, first, last = anchors(text, span)
        keep = shared.value.has(h)
        yield from zip(
            h[keep].view(np.int64).tolist(), first[keep].tolist(), (last - first + 1)[keep].tolist()
        )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value, name in zip(*(c.to_pylist() for c in batch.columns)):
                text = value.encode()
                found: dict[tuple, list[int]] = {}
                for h, first, n in each(text):
                    context = name_of(text[first : first + n - 1 + span])
                    found.setdefault((h, context, n), []).append(first)
                rows += [(name, *k, firsts) for k, firsts in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(PLACES)],
                names=["name", "h", "context", "count", "firsts"],
            )

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, tuple] = {}
            for value in batch.column(0).to_pylist():
                text = value.encode()
                for h, first, n in each(text):
                    body = text[first : first + n - 1 + span]
                    found.setdefault((h, name_of(body)), (n, body))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in found], pa.int64()),
                    pa.array([k[1] for k in found], pa.binary()),
                    pa.array([v[0] for v in found.values()], pa.int32()),
                    pa.array([v[1] for v in found.values()], pa.binary()),
                ],
                names=["h", "context", "count", "body"],
            )

    if wanted is None:
        return docs.select("text").mapInArrow(count, "h long, n long")
    if not contexts:
        return docs.select("text", "name").mapInArrow(
            places, "name binary, h long, context binary, count int, firsts array<int>"
        )
    return docs.select("text").mapInArrow(bodies, "h long, context binary, count int, body binary")


PLACES = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()))


def _merged(families: DataFrame, span: int) -> DataFrame:
    """(family, body_name, run) of contexts (family, body_name, body, count, weight).

    A family's contexts are together in one task; families are merged as many
    at a time as MERGED_BYTES hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= MERGED_BYTES and row[0] != held[-1][0]:
                    yield found_in(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield found_in(held)

    def found_in(held: list[tuple]) -> pa.RecordBatch:
        flags = repeated_starts([r[2] for r in held], [r[3] for r in held], [r[4] for r in held], span)
        rows = [
            (row[0], row[1], first, last)
            for row, own in zip(held, flags)
            for first, last in runs_of(own).tolist()
        ]
        kinds = pa.binary(), pa.binary(), pa.int32(), pa.int32()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
            names=["family", "body_name", "first", "last"],
        )

    dealt = families.select("family", "body_name", "body", "count", "weight")
    # A number is named so that few bytes, much work each, stay over all tasks.
    tasks = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(tasks, "family")
        .sortWithinPartitions("family", "body_name")
        .mapInArrow(run, "family binary, body_name binary, first int, last int")
    )


def _refined(rows: DataFrame, span: int) -> DataFrame:
    """Each context of a large family parted in two, whose families share more bytes.

    All passages of a family share ``known`` bytes from ``at`` on. Those with
    at least half of the others behind them go one way, named by that half;
    the rest have as much before, and are named by that. When nothing is left
    to share, equal families are equal passages.
    """
    kind = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    names = rows.columns

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at, known, count, body = row["at"], row["known"], row["count"], row["body"]
                half = -(-(span - known) // 2)
                cut = min(max(at - (span - known - half), 0), count)
                if cut < count:  # passages from cut on have half behind
                    shared = body[at + known : at + known + half]
                    out.append(
                        row
                        | {"body": body[cut:], "base": row["base"] + cut, "count": count - cut, "at": at - cut}
                        | {"known": known + half, "family": name_of(row["family"] + b">" + shared)}
                    )
                if cut:
                    shared = body[at - half : at]
                    out.append(
                        row
                        | {"body": body[: cut - 1 + span], "count": cut, "at": at - half}
                        | {"known": known + half, "family": name_of(row["family"] + b"<" + shared)}
                    )
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return rows.select(names).mapInArrow(part, kind)


def repeated_runs(docs: DataFrame, span: int) -> DataFrame:
    """(name, first, last): runs of passages of ``docs`` (text, name) that occur elsewhere."""
    found = _scan(docs, span, None, False).groupBy("h").agg(F.sum("n").alias("n"))
    often = make_filter(found.where("n > 1"), "h")
    places = durable(_scan(docs, span, often, False))
    contexts = durable(
        places.groupBy("h", "context").agg(
            F.sum(F.size("firsts")).alias("weight"), F.max("count").alias("count")
        )
    )
    families = contexts.groupBy("h").agg(F.count("*").alias("kinds"))
    # One context only: every passage of it is repeated as often as it is.
    alone = contexts.join(families.where("kinds = 1"), "h").where("weight > 1")
    results = [
        alone.select(
            "h", "context", F.lit(0).alias("first"), (F.col("count") - 1).cast("int").alias("last")
        )
    ]
    mixed = durable(contexts.join(families.where("kinds > 1").select("h"), "h"))
    bodies = _scan(docs, span, make_filter(mixed.select("h").distinct(), "h"), True)
    bodies = bodies.groupBy("h", "context").agg(F.first("body").alias("body"))
    rows = mixed.join(bodies, ["h", "context"]).select(
        "h",
        "context",
        F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("family"),
        F.col("context").alias("body_name"),
        "body",
        F.lit(0).alias("base"),
        "count",
        F.lit(GRAM).alias("known"),
        "weight",
    )
    rows = durable(_with_anchor(rows, span))
    while True:
        sizes = rows.select("family", "body_name").distinct().groupBy("family").agg(F.count("*").alias("kinds"))
        large = sizes.where(F.col("kinds") > FAMILY).select("family")
        small = rows.join(large, "family", "left_anti")
        one = small.groupBy("family", "body_name").agg(
            F.first("body").alias("body"), F.max("count").alias("count"), F.sum("weight").alias("weight")
        )
        hits = durable(_merged(one, span))
        results.append(
            small.select("h", "context", "family", "body_name", "base")
            .join(hits, ["family", "body_name"])
            .select(
                "h",
                "context",
                (F.col("base") + F.col("first")).alias("first"),
                (F.col("base") + F.col("last")).alias("last"),
            )
        )
        more = rows.join(large, "family", "left_semi")
        if more.isEmpty():
            break
        parted = _refined(more, span).withColumn("body_name", text_name("body"))
        rows = durable(parted)
    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    hit = places.join(every, ["h", "context"])
    return hit.select("name", F.explode("firsts").alias("at"), "first", "last").select(
        "name", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")
    )


def _with_anchor(rows: DataFrame, span: int) -> DataFrame:
    """The place of the anchor in each context: that of its only run of passages."""
    kind = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = [anchor_place(body, span) for body in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.int32())], names=[*batch.schema.names, "at"]
            )

    return rows.mapInArrow(find, kind + ", at int")


def anchor_place(body: bytes, span: int) -> int:
    """Where the anchor of a context's first passage stands."""
    h = gram_hashes(np.frombuffer(body, np.uint8)[:span], GRAM)
    return int(np.argmin(h >> np.uint64(22)))


def cut_repeats(
    docs: DataFrame, span: int = 200, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every byte of a passage of ``span`` bytes that also starts elsewhere is cut.

    (key, n_bytes, n_removed, spans array<struct<first, stop>>, kept binary):
    texts are UTF-8, passages lie within a text and may overlap, the same text
    included, and are judged on the input. ``kept`` are the other bytes, so it
    need not be whole characters. One row for each row, repeated rows being
    each other's elsewhere; NULL and empty texts have no bytes. ``span`` is
    even and greater than GRAM.
    """
    if span % 2 or span <= GRAM:
        raise ValueError(f"span must be even and greater than {GRAM}")
    source = texts(docs, key, text).select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text"))
    named = source.withColumn("name", text_name("text"))
    runs = repeated_runs(named.select("text", "name"), span)
    per_text = (
        runs.distinct()
        .groupBy("name")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    )
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (k, *cut_runs(t.encode(), [(r["first"], r["last"] + span) for r in runs or ()]))
                for k, t, runs in zip(*(c.to_pylist() for c in batch.columns))
            ]
            spans = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], batch.column(0).type),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([[{"first": a, "stop": b} for a, b in r[3]] for r in rows], spans),
                    pa.array([r[4] for r in rows], pa.binary()),
                ],
                names=[key, "n_bytes", "n_removed", "spans", "kept"],
            )

    joined = named.join(per_text, "name", "left").select("k", "text", "runs")
    return joined.mapInArrow(
        cut,
        f"`{key}` {kind}, n_bytes long, n_removed long, spans array<struct<first: long, stop: long>>, kept binary",
    )


def cut_runs(
    text: bytes, runs: list[tuple[int, int]]
) -> tuple[int, int, list[tuple[int, int]], bytes]:
    """(bytes, bytes cut, maximal runs cut, the rest) for sorted runs (first, stop)."""
    spans: list[tuple[int, int]] = []
    for first, stop in runs:
        if spans and first <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(stop, spans[-1][1])
        else:
            spans.append((first, stop))
    edges = [0, *(x for s in spans for x in s), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return len(text), len(text) - len(kept), spans, kept
