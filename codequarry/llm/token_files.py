"""Token ids in files of patched frame-of-reference blocks.

A file is a Parquet table with one row for each segment of consecutive
documents, so any store that Spark reads will do and a reader can take
segments in parallel. The row names the documents and their token counts; its
``payload`` holds their ids:

    bytes 0-3    the mark PFR1
    4-11         number of ids (unsigned 64 bit, little-endian as all that follows)
    12-15        number of blocks, B
    then         B block starts, unsigned 32 bit, from the payload's first byte
    then         the blocks

A block stands for BLOCK ids (the last is filled up with its own minimum):

    bytes 0-3    minimum, unsigned 32 bit
    4            width w in bits
    5            number of exceptions, e
    then         16 w bytes: the low w bits of id - minimum, id i in bits i w to i w + w
    then         e positions (8 bit), then e high parts (id - minimum) >> w (32 bit)

``w`` holds at least PERCENT of a hundred ids of the block; the others are the
exceptions.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import Recent, texts

MARK = b"PFR1"
BLOCK = 128
PERCENT = 90
# Ids after which a segment is closed; a longer document has a segment to itself.
SEGMENT_IDS = 1 << 17
# Bytes of the words that each Python worker remembers.
MEMO_BYTES = 64 << 20


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs; 0 needs none."""
    if values.size and values.max() < len(_BITS):
        return _BITS[values]
    return np.frexp(values.astype(np.float64))[1].astype(np.int8)


_BITS = np.repeat(np.arange(17, dtype=np.int8), [1, *(1 << b for b in range(16))])


def pack_columns(values: np.ndarray, width: int) -> np.ndarray:
    """(128, m) values below 2**width as (2 * width, m) 64-bit words."""
    words = np.zeros((2 * width, values.shape[1]), np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        words[word] |= values[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= values[i] >> np.uint64(64 - shift)
    return words


def unpack_columns(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack_columns``."""
    values = np.zeros((BLOCK, words.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[word + 1] << np.uint64(64 - shift))
        values[i] = value & mask
    return values


def pack(ids: np.ndarray) -> bytes:
    """A payload from ids below 2**32."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return MARK + struct.pack("<QI", 0, 0)
    full = np.empty(blocks * BLOCK, np.int64)
    full[:n] = ids
    full[n:] = ids[(blocks - 1) * BLOCK :].min()
    rows = full.reshape(blocks, BLOCK)
    least = rows.min(axis=1)
    rest = (rows - least[:, None]).astype(np.uint64)
    needed = bit_lengths(rest)
    place = -(-BLOCK * PERCENT // 100) - 1
    widths = np.partition(needed, place, axis=1)[:, place].astype(np.int64)
    block, where = np.nonzero(needed > widths[:, None])
    exceptions = np.bincount(block, minlength=blocks)
    sizes = 6 + 16 * widths + 5 * exceptions
    head = 16 + 4 * blocks
    starts = head + np.cumsum(sizes) - sizes
    if starts[-1] >= 1 << 32:
        raise ValueError("a payload of 4 GB or more: the document has too many ids")
    out = np.zeros(head + int(sizes.sum()), np.uint8)
    out[:head] = np.frombuffer(
        MARK + struct.pack("<QI", n, blocks) + starts.astype("<u4").tobytes(), np.uint8
    )
    out[starts[:, None] + np.arange(4)] = least.astype("<u4")[:, None].view(np.uint8)
    out[starts + 4], out[starts + 5] = widths, exceptions
    for width in np.unique(widths[widths > 0]).tolist():
        own = np.flatnonzero(widths == width)
        low = np.ascontiguousarray((rest[own] & np.uint64((1 << width) - 1)).T)
        packed = np.ascontiguousarray(pack_columns(low, width).T).astype("<u8")
        out[starts[own][:, None] + 6 + np.arange(16 * width)] = packed.view(np.uint8)
    first = starts + 6 + 16 * widths  # of the exceptions
    turn = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    out[first[block] + turn] = where
    high = (rest[block, where] >> widths[block].astype(np.uint64)).astype("<u4")
    at = first[block] + exceptions[block] + 4 * turn
    out[at[:, None] + np.arange(4)] = high[:, None].view(np.uint8)
    return out.tobytes()


def unpack(payload: bytes, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``stop``, found by the index of block starts."""
    if payload[:4] != MARK:
        raise ValueError("not a payload of token ids")
    n, blocks = struct.unpack_from("<QI", payload, 4)
    stop = blocks if stop is None else min(stop, blocks)
    if first >= stop:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    starts = np.frombuffer(payload, "<u4", blocks, 16)[first:stop].astype(np.int64)
    least = raw[starts[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.int64)
    widths, exceptions = raw[starts + 4], raw[starts + 5].astype(np.int64)
    rows = np.empty((stop - first, BLOCK), np.int64)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        at = starts[own][:, None] + 6 + np.arange(16 * width)
        words = np.ascontiguousarray(raw[at]).view("<u8") if width else np.zeros((len(own), 0))
        rows[own] = unpack_columns(np.ascontiguousarray(words.T), width).T
    block = np.repeat(np.arange(stop - first), exceptions)
    turn = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    begin = (starts + 6 + 16 * widths.astype(np.int64))[block]
    at = begin + exceptions[block] + 4 * turn
    high = raw[at[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.int64)
    rows[block, raw[begin + turn]] += high << widths[block].astype(np.int64)
    ids = (rows + least[:, None]).reshape(-1)
    return ids[: min(n, stop * BLOCK) - first * BLOCK].astype(np.uint32)


# Lower-case Latin letters that neither composition nor case folding changes.
_SMALL = "a-z" + "".join(
    c for c in map(chr, range(0xDF, 0x180)) if c.isalpha() and c == c.lower() == normalize("NFC", c)
)
# Words of such letters and of printable ASCII; quotes may begin a contraction.
_SIMPLE = re.compile(rf"(?!.*')[{_SMALL}!-@\[-~]+")
_PARTS = re.compile(rf"[{_SMALL}]+|[0-9]|[^{_SMALL}0-9]+")


def _shown(byte: int) -> str:
    """The character by which byte-level models show a byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    if byte in plain:
        return chr(byte)
    return chr(256 + sum(b not in plain for b in range(byte)))


# What a tokenizer file must say for words to be encoded apart.
_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class WordEncoder:
    """The ids of whole texts, put together from the ids of their words.

    Special tokens are cut out first, with their own case, as the library
    does. In what is between, spaces and line ends part the pieces of such a
    tokenizer, so a word's ids depend on nothing around it, and the library is
    asked for each word once. Simple words (see _SIMPLE) are cut here into the
    pieces its pattern takes: runs of letters, single digits, runs of anything
    else; each goes straight to the library's model. Any other word goes to
    the whole library. A file with other rules than _RULES gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        added = said["added_tokens"]
        odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["special"] for t in added)
        self.by_words = not odd and all(said.get(name) == rule for name, rule in _RULES.items())
        self.special = {t["content"].encode(): _packed([t["id"]]) for t in added}
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(longest) + b")").split if longest else lambda raw: [raw]
        if self.by_words:  # all special tokens are cut out before
            self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.words = Recent(self._word, MEMO_BYTES)
        self.show = {byte: _shown(byte) for byte in range(256)}

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self._piece(word.decode())
        text = word.decode()
        if not _SIMPLE.fullmatch(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = _PARTS.findall(text)
        if len(parts) > 1:
            return b"".join([self.words[part.encode()] for part in parts])
        return self._piece("".join(map(self.show.__getitem__, word)))

    def _piece(self, shown: str) -> bytes:
        return _packed([token.id for token in self.tokenize(shown)])

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        raw = text.encode()
        parts = self.cut(raw)
        return b"".join([self.special[x] if i % 2 else self._between(x) for i, x in enumerate(parts)])

    def _between(self, raw: bytes) -> bytes:
        """Text without special tokens; A to Z are folded, as the library would."""
        raw = raw.lower().replace(b"\n", b" ")
        return b"".join(map(self.words.__getitem__, filter(None, raw.split(b" "))))


def _packed(ids: list[int]) -> bytes:
    return _FORMATS[len(ids)].pack(*ids) if len(ids) < len(_FORMATS) else struct.pack(f"<{len(ids)}I", *ids)


_FORMATS = [struct.Struct(f"<{n}I") for n in range(32)]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode whole texts, end each with the id ``end``, write them in key order.

    Documents are range-partitioned by ``key`` and sorted, so files and the
    segments in them follow the key; NULL keys come first, equal keys by text.
    A NULL text has the end id only. An empty table gives a folder without
    segments. Existing files are replaced. ``tokenizer`` must be a file that
    every executor has, of a tokenizer that drops white space.
    """
    source = texts(docs, key, text).withColumn(text, F.coalesce(text, F.lit("")))
    ordered = source.repartitionByRange(key).sortWithinPartitions(key, text)
    kind = source.schema[key].dataType.simpleString()
    names = ["file", "start", "keys", "counts", "n_ids", "payload"]

    def segments(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_encoder(tokenizer)
        tail = struct.pack("<I", end)
        keys: list = []
        held: list[bytes] = []
        start = size = 0
        key_type = None

        def close() -> pa.RecordBatch:
            counts = [len(x) // 4 for x in held]
            row = part, start, keys, counts, size, pack(np.frombuffer(b"".join(held), "<u4"))
            longs = pa.list_(pa.int64())
            types = pa.int64(), pa.int64(), pa.list_(key_type), longs, pa.int64(), pa.binary()
            columns = [pa.array([value], kind) for value, kind in zip(row, types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = own.encode(t) + tail
                if held and size + len(ids) // 4 > SEGMENT_IDS:
                    yield close()
                    start += size
                    keys, held, size = [], [], 0
                keys.append(k)
                held.append(ids)
                size += len(ids) // 4
        if held:
            yield close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from segments(TaskContext.get().partitionId(), batches)

    schema = (
        f"file long, start long, keys array<{kind}>, counts array<long>, n_ids long, payload binary"
    )
    # The payloads are packed already.
    written = ordered.mapInArrow(run, schema).write.mode("overwrite")
    written.option("compression", "uncompressed").parquet(path)


def read_token_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids binary) of every document in the files' rows.

    ``start`` counts the ids of all documents before it: those before it in
    its file, as written there, and those of earlier files. Files are as many
    as writing tasks, and a sum of each is all that meets.
    """
    totals = files.groupBy("file").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                file, start, keys, counts, payload = (c[row] for c in batch.columns)
                ids = unpack(payload.as_py()).astype("<u4").tobytes()
                lengths = np.array(counts.as_py(), np.int64)
                stops = np.cumsum(lengths)
                starts = stops - lengths
                parts = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file.as_py()] * len(parts), pa.int64()),
                        keys.values,
                        pa.array(starts + start.as_py(), pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(parts, pa.binary()),
                    ],
                    names=["file", key, "inside", "n_tokens", "ids"],
                )

    rows = files.select("file", "start", "keys", "counts", "payload").mapInArrow(
        documents, f"file long, `{key}` {kind}, inside long, n_tokens long, ids binary"
    )
    # One row for each writing task.
    return rows.join(F.broadcast(bases), "file").select(
        key, (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids"
    )
