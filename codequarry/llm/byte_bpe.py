"""Byte-level BPE, encoding and decoding, with a segment tree over byte positions."""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codequarry.llm.common import Recent, texts

# Above all ranks, and one digit to Python, which compares such numbers faster.
NO_PAIR = (1 << 30) - 1
# Children of a node of the tree.
FAN = 32
# Bytes of each memo in a Python worker.
MEMO_BYTES = 64 << 20
# A space that follows white space: cutting there would divide a run of it.
RUN = re.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base 64 and its rank, below NO_PAIR, on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if max(ranks.values(), default=0) >= NO_PAIR:
        raise ValueError(f"ranks must be below {NO_PAIR}")
    return ranks


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece.

    Leaf ``i`` of the tree holds the rank of the pair whose left token starts
    at byte ``i``; an inner node holds the least rank of its FAN children. The
    least of the top level tells whether a merge is left, and a walk down, the
    first equal child each time, finds the leftmost pair of least rank. A merge
    changes three leaves: the pair gone, the pair that now starts there, and
    the pair of the left neighbour. Most pieces are short and all leaf.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    get = ranks.get
    leaves = [get(piece[i : i + 2], NO_PAIR) for i in range(n - 1)]
    leaves.append(NO_PAIR)
    levels = [leaves]  # the top level last
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top, inner = levels[-1], levels[-2::-1]

    def renew(leaf: int) -> None:
        below = leaves
        for level in levels[1:]:
            leaf //= FAN
            least = min(below[FAN * leaf : FAN * leaf + FAN])
            if level[leaf] == least:
                return
            level[leaf] = least
            below = level

    end = list(range(1, n + 1))  # where the live token that starts here ends
    before = list(range(-1, n))  # the live token that ends here starts
    while (least := min(top)) < NO_PAIR:
        i = top.index(least)
        for below in inner:
            i = below.index(least, FAN * i, FAN * i + FAN)
        middle = end[i]
        stop = end[middle]
        end[i] = stop
        leaves[middle] = NO_PAIR
        if stop < n:
            leaves[i] = get(piece[i : end[stop]], NO_PAIR)
            before[stop] = i
        else:
            leaves[i] = NO_PAIR
        if i:
            left = before[i]
            leaves[left] = get(piece[left:stop], NO_PAIR)
        if inner:
            renew(middle)
            renew(i)
            if i:
                renew(left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encoder and decoder of one rank file, with bounded memos.

    A text without white space before a space is cut at its spaces: every
    match of PATTERN then lies within one chunk, so a chunk's ids depend
    on nothing else and can be kept. Any other text is matched whole, and so
    is every text under another pattern.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.cuts = pattern == public_tokenizers.PATTERN
        self.pieces = Recent(self._piece, MEMO_BYTES)
        self.chunks = Recent(self._chunk, MEMO_BYTES)

    def _piece(self, piece: str) -> bytes:
        ids = merge_piece(piece.encode(), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        found = self.find(chunk)
        return self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.cuts or RUN.search(text):
            return b"".join(map(self.pieces.__getitem__, self.find(text)))
        chunks = text.split(" ")
        rest = self.chunks
        first = rest[chunks[0]] if chunks[0] else b""
        return first + b"".join([rest[" " + chunk] for chunk in chunks[1:]])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of this Python worker, kept from task to task."""
    return Codec(path, pattern)


def encode_texts(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_tokens long, ids binary): each match of ``pattern`` merged by the ranks.

    ``ids`` are little-endian unsigned 32-bit integers. One row for each input
    row, in any order, repeated rows included; NULL is an empty text. The file
    at ``path`` must be on every executor.
    """
    source = texts(docs, key, text)
    kind = source.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=[key, "n_tokens", "ids"],
            )

    return source.mapInArrow(encode, f"`{key}` {kind}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded binary): the bytes that the ids stand for.

    An id outside the vocabulary ends the job with a KeyError.
    """
    kind = encoded.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            decoded = [own.decode(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())],
                names=[key, "n_tokens", "ids", "decoded"],
            )

    return encoded.select(key, "n_tokens", "ids").mapInArrow(
        decode, f"`{key}` {kind}, n_tokens long, ids binary, decoded binary"
    )


def with_ids(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and ids, checked: ids that do not decode to the text end the job.

    NULL has no ids. Columns of these names are replaced.
    """
    docs = docs.drop("n_tokens", "ids")
    place = docs.columns.index(text)
    texts(docs, text, text)  # small batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [t or "" for t in batch.column(place).to_pylist()]
            ids = [own.encode(t) if t else b"" for t in raw]
            for t, x in zip(raw, ids):
                if own.decode(x) != t.encode():
                    raise ValueError("ids do not decode to their text")
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=[*batch.schema.names, "n_tokens", "ids"],
            )

    schema = T.StructType(
        [*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    return docs.mapInArrow(run, schema)
