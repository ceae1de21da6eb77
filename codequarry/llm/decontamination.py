"""Passages of a test set in a corpus, by a positional inverted index.

The index holds the postings of every word of the corpus and can be kept and
asked again. It is cut by documents: a shard holds the postings of some
consecutive rows, so every list that an intersection needs lies in one row of
the index, and a match never needs a shuffle. Positions count words through
the shard, with a gap after each document that no match can bridge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import text_name, texts
from codequarry.session import scratch_path

# On the bytes of a text, with A to Z folded by bytes.lower: every byte of a
# character beyond ASCII is part of a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Words after which a shard of the index is closed.
SHARD_WORDS = 1 << 18
# Words of test items that one pass over the index looks for; further items
# are looked for in further passes.
BLOCK_WORDS = 1 << 19
# Empty places after a document: no match may be longer.
GAP = 256
# Windows, and pairs of a window and a place, that are thinned together.
NEAR_WINDOWS = 1 << 16
NEAR_PAIRS = 1 << 19
INDEX = (
    "shard long, gap int, vocabulary binary, counts binary, positions binary, "
    "keys array<{kind}>, words array<int>"
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A to Z folded; NULL has none."""
    return WORD.findall(text.encode().lower()) if text else []


@dataclass
class Queries:
    """Windows of a block of test items, as numbers of a vocabulary."""

    terms: dict[bytes, int]
    windows: list[tuple[int, ...]]  # distinct
    items: list[list[str]]  # of each window
    size: int


def make_queries(items: list[tuple[str, str | None]], size: int) -> Queries:
    """Every ``size`` consecutive words of an item; all of one that has fewer, if any."""
    terms: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[str]] = {}
    for item, text in items:
        own = [terms.setdefault(w, len(terms)) for w in words_of(text)]
        last = max(0, len(own) - size)
        for start in range(last + 1 if own else 0):
            names = found.setdefault(tuple(own[start : start + size]), [])
            if not names or names[-1] != item:
                names.append(item)
    return Queries(terms, list(found), list(found.values()), size)


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of all words of whole texts, a row for each shard, written to ``path``.

    ``vocabulary`` are a shard's distinct words with spaces between them,
    ``counts`` how often each occurs, ``positions`` where, one list after the
    other, as 32-bit integers.
    """
    source = texts(docs, key, text)
    kind = source.schema[key].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        keys: list = []
        sizes: list[int] = []
        held: list[bytes] = []
        key_type = None

        def close() -> pa.RecordBatch:
            coded = pa.array(held, pa.binary()).dictionary_encode()
            codes = coded.indices.to_numpy() if held else np.zeros(0, np.int32)
            shift = np.repeat(np.arange(len(sizes), dtype=np.int64) * GAP, sizes)
            places = (np.arange(len(held)) + shift)[np.argsort(codes, kind="stable")].astype("<i4")
            row = (
                (part << 32) + number,
                GAP,
                b" ".join(coded.dictionary.to_pylist()),
                np.bincount(codes, minlength=len(coded.dictionary)).astype("<i4").tobytes(),
                places.tobytes(),
                keys,
                sizes,
            )
            types = pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(key_type), pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(row, types)],
                names=["shard", "gap", "vocabulary", "counts", "positions", "keys", "words"],
            )

        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                keys.append(k)
                sizes.append(len(words))
                held += words
                if len(held) + GAP * len(sizes) >= SHARD_WORDS:
                    yield close()
                    number += 1
                    keys, sizes, held = [], [], []
        if keys:
            yield close()

    schema = INDEX.format(kind=kind)
    source.mapInArrow(shards, schema).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def document_frequencies(index: DataFrame, queries: Queries) -> dict[int, int]:
    """Postings of each term of ``queries`` over the whole corpus: as many rows as it has terms."""
    vocabulary = index.sparkSession.sparkContext.broadcast(queries.terms)  # at most BLOCK_WORDS

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            for words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                numbers = [get(w, -1) for w in words.split(b" ")] if counts else []
                numbers = np.array(numbers, np.int64)
                own = numbers >= 0
                sizes = np.frombuffer(counts, "<i4").astype(np.int64)[own]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[own]), pa.array(sizes)], names=["term", "n"])

    found = index.select("vocabulary", "counts").mapInArrow(known, "term long, n long")
    return {row.term: row.n for row in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _lists(words: bytes, counts: bytes, positions: bytes, terms: dict[bytes, int]) -> dict[int, np.ndarray]:
    """The postings of a shard by the numbers of ``terms``."""
    sizes, places = np.frombuffer(counts, "<i4"), np.frombuffer(positions, "<i4")
    stops = np.cumsum(sizes, dtype=np.int64).tolist()
    found = {}
    for word, size, stop in zip(words.split(b" "), sizes.tolist(), stops):
        number = terms.get(word)
        if number is not None:
            found[number] = places[stop - size : stop]
    return found


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Of sorted ``values``, those in sorted ``among``."""
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return values[among[at] == values]


def phrase_starts(window: tuple[int, ...], order: list[int], lists: dict[int, np.ndarray]) -> np.ndarray:
    """Where the words of ``window`` stand consecutively.

    ``order`` are its offsets, the rarest word first; each further list is
    moved by its offset and intersected with the starts that are left.
    """
    starts = None
    for offset in order:
        own = lists.get(window[offset])
        if own is None:
            return np.zeros(0, np.int32)
        own = own - offset
        starts = own if starts is None else _within(starts, own)
        if not len(starts):
            break
    return starts


@dataclass
class Near:
    """Windows as arrays: their distinct words, the rarest first, and how many of each must be within a length."""

    terms: np.ndarray  # (windows, size), filled up with the number of no word
    needed: np.ndarray  # (windows, size), filled up with zeros
    lengths: np.ndarray
    items: list[list[str]]
    words: int  # numbers of words, and the number of no word


def make_near(windows: list[tuple], size: int, slop: int, words: int) -> Near:
    """``windows`` are (numbers of words, offsets from the rarest word on, items)."""
    terms = np.full((len(windows), size), words, np.int32)
    needed = np.zeros((len(windows), size), np.int32)
    for i, (window, order, _) in enumerate(windows):
        counts: dict[int, int] = {}
        for offset in order:
            counts[window[offset]] = counts.get(window[offset], 0) + 1
        terms[i, : len(counts)], needed[i, : len(counts)] = list(counts), list(counts.values())
    lengths = np.array([len(w) + slop for w, _, _ in windows], np.int64)
    return Near(terms, needed, lengths, [names for _, _, names in windows], words)


def near_places(near: Near, lists: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
    """(window, place of its rarest word) that have as many of each of its words in reach as it needs.

    All pairs of a shard are thinned together, from the rarest word on, by
    counts in one sorted array of words and places.
    """
    if not lists:
        return
    own = np.array(sorted(lists), np.int64)
    held = np.zeros(near.words + 1, np.int64)
    held[own] = [len(lists[t]) for t in own.tolist()]
    firsts = np.cumsum(held) - held
    places = np.concatenate([lists[t] for t in own.tolist()]).astype(np.int64)
    keys = np.repeat(own << 32, held[own]) + places
    for part in range(0, len(near.terms), NEAR_WINDOWS):
        known = held[near.terms[part : part + NEAR_WINDOWS]] >= near.needed[part : part + NEAR_WINDOWS]
        some = np.flatnonzero(known.all(axis=1)) + part
        counts = held[near.terms[some, 0]]
        ends = np.cumsum(counts)
        start = 0
        while start < len(some):
            before = int(ends[start] - counts[start])
            stop = max(start + 1, int(np.searchsorted(ends, before + NEAR_PAIRS, "right")))
            n = counts[start:stop]
            window = np.repeat(some[start:stop], n)
            at = np.arange(len(window)) - np.repeat(ends[start:stop] - n - before, n)
            place = places[at + firsts[near.terms[window, 0]]]
            for column in range(near.terms.shape[1]):
                need = near.needed[window, column]
                if not column and (need == 1).all():
                    continue
                word, length = near.terms[window, column].astype(np.int64) << 32, near.lengths[window]
                after = np.searchsorted(keys, word + place + length)
                keep = after - np.searchsorted(keys, word + np.maximum(place - length + 1, 0)) >= need
                window, place = window[keep], place[keep]
            yield from zip(window.tolist(), place.tolist())
            start = stop


def stands_near(near: Near, number: int, place: int, lists: dict[int, np.ndarray]) -> bool:
    """Whether a span not over a window's length, around ``place``, has all its words in any order."""
    length = int(near.lengths[number])
    needed = {t: n for t, n in zip(near.terms[number].tolist(), near.needed[number].tolist()) if n}
    around = []
    for t in needed:
        own = lists[t]
        a, b = np.searchsorted(own, (place - length + 1, place + length))
        around += [(p, t) for p in own[a:b].tolist()]
    around.sort()
    have = dict.fromkeys(needed, 0)
    left, missing = 0, sum(needed.values())
    for p, t in around:
        have[t] += 1
        missing -= have[t] <= needed[t]
        while not missing:
            first, u = around[left]
            if p - first < length:
                return True
            have[u] -= 1
            missing += have[u] < needed[u]
            left += 1
    return False


def matches(index: DataFrame, queries: Queries, slop: int | None = None, key: str = "doc_id") -> DataFrame:
    """(shard, place, key, n_words, starts, stops, items, near) of every document of the index.

    ``starts`` and ``stops`` are the words covered by exact windows, as
    disjoint runs; ``items`` the distinct items with an exact window; ``near``
    those with a window all of whose words stand within ``slop`` extra words, in
    any order (empty if ``slop`` is None).
    """
    kind = index.schema["keys"].dataType.elementType.simpleString()
    if queries.size + (slop or 0) > GAP:
        raise ValueError(f"a window and its slop may have {GAP} words")
    frequencies = document_frequencies(index, queries)
    # Windows with a word that the corpus lacks can't occur.
    alive: dict[int, list] = {}  # by rarest word
    for w, names in zip(queries.windows, queries.items):
        order = sorted(range(len(w)), key=lambda i: (frequencies.get(w[i], 0), i))
        if frequencies.get(w[order[0]], 0):
            alive.setdefault(w[order[0]], []).append((w, order, names))
    every = [own for group in alive.values() for own in group] if slop is not None else []
    nearly = make_near(every, queries.size, slop or 0, len(queries.terms))
    shipped = index.sparkSession.sparkContext.broadcast((alive, queries.terms, nearly))  # at most BLOCK_WORDS windows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(*(column[row] for column in batch.columns))

    def one(shard, gap, words, counts, positions, keys, sizes) -> pa.RecordBatch:
        windows, terms, nearly = shipped.value
        lists = _lists(words.as_py(), counts.as_py(), positions.as_py(), terms)
        lengths = sizes.values.to_numpy().astype(np.int64)
        bases = np.concatenate(([0], np.cumsum(lengths + gap.as_py())))
        n = len(lengths)
        runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        here = (x for term in lists for x in windows.get(term, ()))
        for window, order, names in here:
            starts = phrase_starts(window, order, lists)
            for start, doc in zip(
                starts.tolist(), (np.searchsorted(bases, starts, "right") - 1).tolist()
            ):
                first = start - int(bases[doc])
                runs[doc].append((first, first + len(window)))
                items[doc].update(names)
        near = [set(x) if slop is not None else set() for x in items]  # an exact window has all its words
        for number, place in near_places(nearly, lists):
            doc = int(np.searchsorted(bases, place, "right")) - 1
            if not near[doc].issuperset(nearly.items[number]) and stands_near(nearly, number, place, lists):
                near[doc].update(nearly.items[number])
        merged = [merge_runs(r) for r in runs]
        longs, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard.as_py()] * n, pa.int64()),
                pa.array(np.arange(n), pa.int32()),
                keys.values,
                pa.array(lengths, pa.int64()),
                pa.array([[a for a, _ in r] for r in merged], longs),
                pa.array([[b for _, b in r] for r in merged], longs),
                pa.array([sorted(x) for x in items], strings),
                pa.array([sorted(x) for x in near], strings),
            ],
            names=["shard", "place", key, "n_words", "starts", "stops", "items", "near"],
        )

    return index.mapInArrow(
        search,
        f"shard long, place int, `{key}` {kind}, n_words long, starts array<long>, stops array<long>, "
        "items array<string>, near array<string>",
    )


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs, in order, that cover what ``runs`` cover."""
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(runs):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(stop, merged[-1][1])
        else:
            merged.append((start, stop))
    return merged


def item_blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """Test items in blocks of about BLOCK_WORDS words, one block in memory at a time."""
    block, size = [], 0
    for name, words in items.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        block.append((name if name is not None else "", words))
        size += len(words or "") // 2
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    slop: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, n_words, starts, stops, items, near): see ``matches``.

    One row for each row of ``docs``, whatever the keys: repeated and NULL
    keys, and repeated rows, included. NULL and texts without words have no
    words and no matches. Items may be NULL, repeated, or none at all.
    """
    index = write_index(docs, scratch_path(docs.sparkSession, "postings"), key, text)
    return search_index(index, items, size, slop, key, item, item_text)


def search_index(
    index: DataFrame,
    items: DataFrame,
    size: int = 10,
    slop: int | None = None,
    key: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """As ``find_passages``, over an index that ``write_index`` made.

    A large test set is looked for block by block; a document's matches are
    put together by its place in the index.
    """
    found = [matches(index, make_queries(block, size), slop, key) for block in item_blocks(items, item, item_text)]
    if not found:
        found.append(matches(index, make_queries([], size), slop, key))
    columns = key, "n_words", "starts", "stops", "items", "near"
    if len(found) == 1:
        return found[0].select(*columns)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    kind = every.schema[key].dataType.simpleString()
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    gathered = every.groupBy("shard", "place").agg(
        F.first(key).alias(key),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))).alias("runs"),
        union("items").alias("items"),
        union("near").alias("near"),
    )

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            runs = [merge_runs([(r["starts"], r["stops"]) for r in row]) for row in batch.column(2).to_pylist()]
            parts = [pa.array([[r[i] for r in row] for row in runs], longs) for i in (0, 1)]
            kept = [batch.column(0), batch.column(1), *parts, batch.column(3), batch.column(4)]
            yield pa.RecordBatch.from_arrays(kept, names=list(columns))

    return gathered.select(key, "n_words", "runs", "items", "near").mapInArrow(
        join_runs,
        f"`{key}` {kind}, n_words long, starts array<long>, stops array<long>, items array<string>, near array<string>",
    )


def without_passages(
    docs: DataFrame, items: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no window of an item.

    What a row holds follows from its text alone, so rows are told by the
    names of their texts, whatever their keys; a NULL text holds nothing.
    """
    found = find_passages(docs.select(text_name(text).alias("name"), F.col(text)), items, size, key="name", text=text)
    bad = found.where(F.size("items") > 0).select(F.col("name").alias("__bad")).distinct()
    return docs.join(bad, text_name(text) == F.col("__bad"), "left_anti")


def covered() -> Column:
    """Words within the runs."""
    return F.aggregate(
        F.zip_with("stops", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x
    )
