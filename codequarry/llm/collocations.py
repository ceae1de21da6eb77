"""Phrases whose words belong together, by best-first growth with score bounds.

A phrase grows to the right, a word at a time. Whatever grows out of a prefix
is at most as frequent as the prefix, and all of it is cut once after the
first word, so the counts of the prefix bound every score that can come of it
(``bound``). Prefixes are expanded from the best bound down, a band of bounds
at a time, until the wanted number of phrases of each language has a score no
prefix that is left can reach.

Texts are read once and kept as chunks of word numbers. Each pass over the
chunks counts the phrases of one length that a band asks for. What it asks for
travels as filters of a fixed number of bits; a filter may let a phrase pass
that nobody asked for, whose count is then right but unused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import ASCII_UPPER, texts
from codequarry.session import durable, scratch_path

# The bytes that part a text into pieces, occurrences that make a
# phrase a candidate, words of the longest, phrases of a language, the score of
# a phrase whose halves never part (times two), and the share of its
# occurrences, in percent, that a longer candidate must have to stand for it.
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
SUPPORT = 30
LONGEST = 4
LIMIT = 2000
UNIT = 2_000_000
ABSORBED = 80

# Bytes of text after which a chunk is closed; cuts are made between pieces.
CHUNK_BYTES = 2 << 20
# Bytes of chunks in one Arrow batch.
BATCH_BYTES = 8 << 20
# Bits of a filter: 8 MiB.
FILTER_BITS = 1 << 26
# The first band ends at the score of so many times LIMIT pairs, the next at
# that of so many times more.
FIRST_BAND, NEXT_BAND = 2, 4
# Parts of a language in which its best phrases are looked for first.
PARTS = 256

UPPER = ASCII_UPPER.encode()
FOLD = bytes.maketrans(UPPER + SEPARATORS + b"\t", UPPER.lower() + b"." * len(SEPARATORS) + b" ")
STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNKS = "lang string, n long, words binary, codes binary"


def write_chunks(docs: DataFrame, path: str, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, n, words, codes): whole texts as numbers of their words, written to ``path``.

    ``words`` are a chunk's distinct words with spaces between them, the last
    of them a dot that stands where a piece ends; ``codes`` are 32-bit places
    in that list; ``n`` counts the words.
    """
    source = texts(docs, lang, text).select(
        F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("t")
    )

    def chunk(lang: str, held: list[bytes]) -> pa.RecordBatch:
        words = b".".join([*held, b""]).replace(b".", b" . ").split()
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        codes = coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        dot = distinct.index(b".")
        n = len(codes) - int((codes == dot).sum())
        order = [*distinct[:dot], *distinct[dot + 1 :], b"."]
        codes = np.where(codes == dot, len(order) - 1, codes - (codes > dot)).astype("<i4")
        row = [pa.array([lang], pa.string()), pa.array([n], pa.int64())]
        row += [pa.array([b" ".join(order)], pa.binary()), pa.array([codes.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(row, names=["lang", "n", "words", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (value.as_py() or b"").translate(FOLD)
                start = 0
                while start < len(raw):
                    stop = raw.find(b".", start + CHUNK_BYTES)
                    stop = len(raw) if stop < 0 else stop + 1
                    held.setdefault(name, []).append(raw[start:stop])
                    size += stop - start
                    start = stop
                    if size >= CHUNK_BYTES:
                        yield from (chunk(*x) for x in held.items())
                        held, size = {}, 0
        yield from (chunk(*x) for x in held.items())

    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    source.mapInArrow(run, CHUNKS).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(CHUNKS).parquet(path)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 1))


def _places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter of ``size`` bits, a power of two, for each hash."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = np.uint64(size - 1)
    return h & low, (h >> np.uint64(34)) & low


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, seven, three = np.uint8(1), np.uint64(7), np.uint64(3)
    found = [bits[p >> three] >> (p & seven).astype(np.uint8) for p in _places(h, 8 * len(bits))]
    return (found[0] & found[1] & one).astype(bool)


def make_filter(phrases: DataFrame):
    """The (lang, phrase) rows as a broadcast of FILTER_BITS bits."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column(0).dictionary_encode()
            h = np.array([_seed(name) for name in lang.dictionary.to_pylist()], np.uint64)[lang.indices.to_numpy()]
            word = pc.split_pattern(batch.column(1), " ").flatten().dictionary_encode()
            own = _hashes([w.encode() for w in word.dictionary.to_pylist()])[word.indices.to_numpy()]
            for column in own.reshape(len(h), -1).T:  # phrases of a filter are of one length
                h = h * STEP + column
            for place in _places(h, FILTER_BITS):
                np.bitwise_or.at(bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        words = bits.view("<i8")
        where = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(words[where])], names=["place", "bits"])

    marked = phrases.select("lang", "phrase").mapInArrow(mark, "place long, bits long")
    table = marked.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 at most
    words = np.zeros(FILTER_BITS // 64, "<i8")
    words[table["place"].to_numpy()] = table["bits"].to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(words.view(np.uint8))


Test = tuple  # (filter, words to skip, words to look at)


def count_phrases(chunks: DataFrame, size: int, ways: list[list[Test]], support: int) -> DataFrame:
    """(lang, phrase, f): phrases of ``size`` words that occur ``support`` times and pass one of ``ways``.

    A way is passed if all its tests are. Equal phrases of a chunk are one row
    before anything moves.
    """
    lengths = sorted({length for way in ways for _, _, length in way})

    def one(lang: str, words: bytes, raw: bytes) -> pa.RecordBatch | None:
        vocabulary = words.split(b" ")
        codes = np.frombuffer(raw, "<i4")
        m = len(codes) - size + 1
        if m <= 0:
            return None
        ends = np.concatenate(([0], np.cumsum(codes == len(vocabulary) - 1, dtype=np.int32)))
        mask = ends[size:] == ends[:m]
        del ends
        if lengths:
            own = _hashes(vocabulary)[codes]
            grams, h = {}, np.full(len(codes) + 1, _seed(lang))
            for length in range(1, lengths[-1] + 1):
                h = h[:-1] * STEP + own[length - 1 :]
                if length in lengths:
                    grams[length] = h
            del own, h
            passed = np.zeros(m, bool)
            for way in ways:
                here = mask.copy()
                for bits, skip, length in way:
                    at = np.flatnonzero(here)
                    here[at] = _passes(bits.value, grams[length][at + skip])
                passed |= here
            mask = passed
            del grams
        at = np.flatnonzero(mask)
        if not len(at):
            return None
        keys = codes[at].astype(np.int64)
        for skip in range(1, size):
            if skip > 1:
                _, keys = np.unique(keys, return_inverse=True)
            keys = keys * len(vocabulary) + codes[at + skip]
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        shown = pa.array(vocabulary, pa.binary())
        parts = [shown.take(pa.array(codes[at[first] + skip])) for skip in range(size)]
        phrases = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(first), pa.string()), phrases, pa.array(counts, pa.int64())],
            names=["lang", "phrase", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = one(*(batch.column(c)[i].as_py() for c in range(3)))
                if found is not None:
                    yield found

    # A chunk a batch: chunks are some megabytes.
    found = chunks.select("lang", "words", "codes").mapInArrow(run, "lang string, phrase binary, n long")
    total = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support)
    return total.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def _words(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def _joined(words: str, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _share(a: str, both: str) -> Column:
    """floor(UNIT * a / both), exact beyond 64 bits."""
    return F.expr(f"(cast({a} as decimal(20,0)) * {UNIT}bd) div cast({both} as decimal(20,0))")


def scored(phrases: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """(lang, phrase, a, l, r, score, bound, cuts) of counted phrases of ``size`` words.

    The cut of the lowest score counts, the first among equals. Of ``size - 1``
    cuts ``cuts`` could be told from ``counts``: with fewer, ``score`` is an
    upper bound. No phrase that begins with this one scores over ``bound``.
    """
    parted = phrases.select("lang", "phrase", F.col("f").alias("a"), _words().alias("w")).select(
        "lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.lit(size - 1))).alias("k")
    )
    parted = parted.select(
        "lang", "phrase", "a", "k",
        _joined("w", F.lit(1), F.col("k")).alias("head"), _joined("w", F.col("k") + 1, F.lit(size) - F.col("k")).alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = parted.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"], "left")
    cut = both.withColumn("both", F.col("l") + F.col("r")).withColumn("score", _share("a", "both"))
    cut = cut.withColumn("least", F.col("l") + F.col("a")).withColumn("bound", _share("a", "least"))
    known = F.col("r").isNotNull()
    low = F.min(F.when(known, F.struct("score", "k", "l", "r")))
    return cut.groupBy("lang", "phrase", "a").agg(
        low.alias("low"),
        F.min("bound").alias("bound"),
        F.count("r").alias("cuts"),
    ).select(
        "lang", "phrase", "a", "low.l", "low.r", F.coalesce("low.score", "bound").alias("score"), "bound", "cuts"
    )


def _first_band_end(pairs: DataFrame, many: int) -> DataFrame:
    """(lang, low): the score of each language's pair number ``many``; 0 if it has fewer."""
    counts = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))  # UNIT / 2 scores at most
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    ranked = counts.withColumn("upto", F.sum("n").over(down))
    low = F.max(F.when(F.col("upto") >= many, F.col("score")))
    return ranked.groupBy("lang").agg(F.coalesce(low, F.lit(0)).cast("long").alias("low"))


def _missing_tails(phrases: DataFrame, known: DataFrame, size: int, length: int) -> DataFrame:
    """(lang, phrase): last words of ``phrases`` that are not counted yet."""
    tails = phrases.select("lang", _joined("w", F.lit(size - length + 1), F.lit(length)).alias("phrase"))
    return tails.distinct().join(known.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def mine(
    docs: DataFrame,
    limit: int = LIMIT,
    support: int = SUPPORT,
    longest: int = LONGEST,
    absorbed: int = ABSORBED,
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``limit`` phrases of each language.

    Only A to Z are folded. A NULL text is empty, a NULL language ``und``. A
    phrase has 2 to ``longest`` words and occurs ``support`` times or more
    within pieces; its score is the lowest of its cuts'. One that lies in a
    longer candidate with ``absorbed`` percent of its occurrences is left out.
    By score and occurrences, highest first, then by the phrase's bytes.
    """
    spark = docs.sparkSession
    chunks = write_chunks(docs, scratch_path(spark, "chunks"), lang, text)
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    words = durable(count_phrases(chunks, 1, [[]], support))
    frequent = make_filter(words)
    level = {1: words, 2: durable(count_phrases(chunks, 2, [[(frequent, 0, 1), (frequent, 1, 1)]], support))}
    pairs = make_filter(level[2])
    ranks = {2: durable(scored(level[2], words, 2))}
    # Every language's open band of bounds, from low up to and without high.
    above = F.lit(UNIT).cast("long")
    many = FIRST_BAND * limit
    bands = durable(_first_band_end(ranks[2], many).select("lang", above.alias("high"), "low"))

    def within(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(bands, "lang").where((F.col(column) >= F.col("low")) & (F.col(column) < F.col("high")))

    def counted(size: int, ways: list[list[Test]]) -> None:
        new = count_phrases(chunks, size, ways, support)
        if size in level:  # counts are of the whole corpus, so either row will do
            new = level[size].union(new).dropDuplicates(["lang", "phrase"])
        level[size] = durable(new)

    while True:
        for size in range(3, longest + 1):
            grown = make_filter(within(ranks[size - 1], "bound"))
            doubtful = make_filter(within(ranks[size - 1].where(F.col("cuts") == size - 2), "score"))
            counted(
                size,
                [[(grown, 0, size - 1), (pairs, size - 2, 2)], [(doubtful, 1, size - 1), (pairs, 0, 2)]],
            )
            ranks[size] = durable(scored(level[size], _union(list(level.values())), size))
            unsure = ranks[size].where(F.col("cuts") < size - 1).join(bands, "lang").where("score >= low")
            unsure = unsure.withColumn("w", _words())
            for length in range(3, size):
                tails = durable(_missing_tails(unsure, level[length], size, length))
                if not tails.isEmpty():
                    counted(length, [[(make_filter(tails), 0, length)]])
                    ranks[length] = durable(scored(level[length], _union(list(level.values())), length))
            if size > 3:
                ranks[size] = durable(scored(level[size], _union(list(level.values())), size))
        found = durable(_survivors(level, ranks, bands, longest, absorbed))
        have = found.groupBy("lang").agg(F.count("*").alias("have"))
        short = (F.coalesce("have", F.lit(0)) < limit) & (F.col("low") > 0)
        state = durable(bands.join(have, "lang", "left").select("lang", "low", short.alias("short")))
        if state.where("short").isEmpty():
            break
        many *= NEXT_BAND
        further = _first_band_end(ranks[2], many).withColumnRenamed("low", "next")
        closer = F.when(F.col("short"), F.col("next")).otherwise(F.col("low"))
        bands = durable(state.join(further, "lang").select("lang", F.col("low").alias("high"), closer.alias("low")))
    return _best(found, limit).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _survivors(
    level: dict[int, DataFrame], ranks: dict[int, DataFrame], bands: DataFrame, longest: int, absorbed: int
) -> DataFrame:
    """(lang, phrase, a, l, r, score) of what scores ``low`` or more and is not absorbed.

    What holds a phrase in a longer candidate also holds it in one that is
    longer by a word, and that one is at least as frequent.
    """
    out = []
    for size in range(2, longest + 1):
        own = ranks[size].where(F.col("cuts") == size - 1).join(bands, "lang").where("score >= low")
        if size < longest:
            longer = level[size + 1].select("lang", _words().alias("w"), "f")
            ends = F.array(_joined("w", F.lit(1), F.lit(size)), _joined("w", F.lit(2), F.lit(size)))
            cover = longer.select("lang", F.explode(ends).alias("phrase"), "f")
            cover = cover.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
            own = own.join(cover, ["lang", "phrase"], "left").where(
                F.col("cover").isNull() | (F.col("cover") * F.lit(100) < F.col("a") * F.lit(absorbed))
            )
        out.append(own.select("lang", "phrase", "a", "l", "r", "score"))
    return _union(out)


def _best(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each language, with their rank.

    First among each of PARTS parts of a language, then among what they leave.
    """
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    near = found.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    )
    near = near.where(F.col("rank") <= limit).drop("rank", "part")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))
