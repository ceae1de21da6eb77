"""Document fingerprints: every shingle hash below a fixed fraction of the hash space."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import texts

# Bytes of a shingle, and the share of hashes that a sketch keeps.
SHINGLE_BYTES = 12
KEPT = 1 / 16
# Characters that are hashed at a time.
CHARS = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive bytes: a mixed polynomial.

    Windows are put together from windows of powers of two.
    """
    base = 0x9E3779B97F4A7C15
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    part, length = raw.astype(np.uint64) + np.uint64(1), 1
    whole, done = None, 0
    while done < size:
        if size & length:
            if whole is None:
                whole, done = part, length
            else:
                n = len(raw) - done - length + 1
                whole = whole[:n] * np.uint64(pow(base, length, 1 << 64)) + part[done : done + n]
                done += length
        if done < size:
            n = len(part) - length
            part = part[:n] * np.uint64(pow(base, length, 1 << 64)) + part[length:]
            length *= 2
    return _mix(whole.copy() if whole is part else whole)


def sketches(values: list[bytes], size: int = SHINGLE_BYTES, kept: float = KEPT) -> list[np.ndarray]:
    """For each text its distinct shingle hashes below the threshold, ascending.

    The threshold is the same for all texts, so the sketch of two texts
    together is the union of theirs and any two can be compared. A text
    shorter than a shingle is one shingle. A text all of whose hashes lie
    above the threshold keeps the least, so only empty texts have an empty
    sketch; merging stays exact as long as such a value is dropped from a
    union that holds a hash below the threshold.
    """
    lengths = np.array([len(v) for v in values], np.int64)
    padded = np.maximum(lengths, size * (lengths > 0))  # short texts end in zero bytes
    stops = np.cumsum(padded)
    raw = np.frombuffer(b"".join(v.ljust(size, b"\0") if v else v for v in values), np.uint8)
    h = window_hashes(raw, size)
    inside = np.ones(len(h), bool)
    for stop in stops[:-1]:  # windows over the end of a text
        inside[max(0, stop - size + 1) : stop] = False
    low = np.flatnonzero(inside & (h < np.uint64(int(kept * 2**64))))
    owner = np.searchsorted(stops, low, "right")
    cuts = np.searchsorted(owner, np.arange(len(values) + 1))
    out = []
    for k in range(len(values)):
        own = np.unique(h[low[cuts[k] : cuts[k + 1]]])
        if not len(own) and lengths[k]:
            own = h[stops[k] - padded[k] : stops[k] - size + 1].min(keepdims=True)
        out.append(own)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of hashes that two sketches have in common; 1 for two empty ones."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    return shared / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the first sketch's hashes that the second has; 1 if it has none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint array<long>) of every row; NULL and empty texts have none."""
    source = texts(docs, key, text)
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _long_lists(found)], names=[key, "fingerprint"]
            )

    return source.mapInArrow(run, f"`{key}` {kind}, fingerprint array<long>")


def below_threshold(hash_: Column, kept: float = KEPT) -> Column:
    """Whether a sketch's hash, as a signed long, was kept for lying below the threshold."""
    return (hash_ >= 0) & (hash_ < F.lit(int(kept * 2**64)))


def merge(rows: DataFrame, by: str, sketch: str = "fingerprint") -> DataFrame:
    """(by, hash): the sketch of all texts of each group together, a row for each hash.

    It is the union of the texts' sketches: what hashing the texts at once
    would give, for their shingles taken one text at a time. The least hash
    that stands in for a text without one below the threshold is dropped from
    a union that has one; a union of such texts alone keeps its least. A large
    group is many rows, and its hashes are made distinct where they lie before
    they move. NULL is a group like any other.
    """
    hashes = rows.select(F.col(by).alias(by), F.explode(sketch).alias("hash")).distinct()
    # Unsigned order: hashes from 2**63 on are negative and come last.
    first = F.struct((F.col("hash") < 0).alias("high"), F.col("hash").alias("hash"))
    has = F.max(below_threshold(F.col("hash"))).alias("has")
    groups = hashes.groupBy(F.col(by).alias("__by")).agg(has, F.min(first).alias("least"))
    both = hashes.join(groups, F.col(by).eqNullSafe(F.col("__by")))
    keep = F.when(F.col("has"), below_threshold(F.col("hash"))).otherwise(F.col("hash") == F.col("least.hash"))
    return both.where(keep).select(by, "hash")


def contained(parts: DataFrame, wholes: DataFrame, part: str, whole: str) -> DataFrame:
    """(part, whole, n_hashes, shared, share) of merged sketches (part, hash) and (whole, hash).

    ``share`` estimates how much of a part a whole has, however unequal they
    are: both keep every hash below one threshold. Pairs that share a hash
    have a row. NULL groups meet nothing.
    """
    sizes = parts.groupBy(part).agg(F.count("*").alias("n_hashes"))
    met = parts.join(wholes, "hash").groupBy(part, whole).agg(F.count("*").alias("shared"))
    return met.join(sizes, part).select(part, whole, "n_hashes", "shared", (F.col("shared") / F.col("n_hashes")).alias("share"))


def _long_lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    flat = np.concatenate([*found, np.zeros(0, np.uint64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of another."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def range_starts(docs: DataFrame, key: str, ranges: int) -> list[int]:
    """Keys at which to cut the rows into about ``ranges`` equal ranges; the least is first."""
    found = docs.agg(
        F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges).alias("cuts"),
        F.min(key).alias("low"),
    ).first()
    return sorted({found.low, *(found.cuts or [])} - {None})


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's sketch beside those of its edited text and of the next text.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, in_edited). The next text is that of the next key; after the
    last comes the first, and a single row is its own next. Equal keys are
    ordered by text, NULL keys come first, a NULL text is empty. Keys are
    whole numbers and should be distinct: rows of one key stay in one task.

    Rows are dealt into ranges of the key and sorted there. What begins a
    range is sent to the range before it as well, as a guest, so each range
    has all it needs and each text moves once, the few first rows twice.
    """
    source = texts(docs, key, text).select(
        F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t")
    )
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = range_starts(source.select("k"), "k", ranges) or [0]
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts))  # as many as tasks
    below = F.size(F.filter(bounds, lambda c: c <= F.col("k")))
    placed = source.withColumn("part", F.greatest(below - 1, F.lit(0)))
    members = placed.select("part", F.lit(0).alias("guest"), "k", "t")
    first = F.col("part") == 0
    guests = placed.where(F.col("k").isin(cuts) | F.col("k").isNull()).select(
        F.when(first, F.lit(len(cuts) - 1)).otherwise(F.col("part") - 1).alias("part"),
        F.lit(1).alias("guest"),
        "k",
        "t",
    )
    ordered = (
        members.union(guests)
        .repartitionById(len(cuts), "part")  # a task for each range
        .sortWithinPartitions("part", "guest", F.col("k").asc_nulls_first(), "t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (part, guest, key, text)
        size = 0
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size >= CHARS:
                    yield rows_from(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield rows_from(held)

    def rows_from(held: list[tuple]) -> pa.RecordBatch:
        own = sketches([row[3].encode() for row in held])
        pairs = [
            (i, held[i][2], held[i][3], edited(held[i][3], held[i + 1][3]).encode())
            for i in range(len(held) - 1)
            if not held[i][1]
        ]
        after = sketches([x[3] for x in pairs])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for _, k, _, _ in pairs], pa.int64()),
                pa.array([len(t) for _, _, t, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for _, _, _, e in pairs], pa.string()),
                _long_lists([own[i] for i, *_ in pairs]),
                _long_lists(after),
                pa.array([likeness(own[x[0]], e) for x, e in zip(pairs, after)], pa.float64()),
                pa.array([likeness(own[x[0]], own[x[0] + 1]) for x in pairs], pa.float64()),
                pa.array([containment(own[x[0]], e) for x, e in zip(pairs, after)], pa.float64()),
            ],
            names=[
                key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                "near_edited", "near_next", "in_edited",
            ],
        )

    return ordered.mapInArrow(
        run,
        f"`{key}` long, n_chars long, edited_sha256 string, fingerprint array<long>, "
        "edited_fingerprint array<long>, near_edited double, near_next double, in_edited double",
    )
