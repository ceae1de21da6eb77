"""Phrases, hard negatives and shards against plain Python."""

from __future__ import annotations

import os
import zlib

import pytest

from codequarry.llm import collocations, negatives, shards
from codequarry.llm.common import load
from tests.llm import brute

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: entry.run for name, entry in load().items()}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "a", ". . .", "a b.a b\ta b", "A b C d. a B c D, a b c d; a b c d!a b c d", "b c d " * 40,
    "x y z " * 30 + "\n", "é ü é ü é ü. é ü", "one\x0btwo\x0cthree one two", "q " * 3000, "under the mit license. " * 9,
    "\x1c a\x1cb c", "漢字 かな " * 12,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts in three languages and none, repeated, with clashing columns."""
    rows = [(i, t, ("en", None, "", "und")[i % 4], "s", 1, 2, "w", 3) for i, t in enumerate(ODD * 3)]
    return spark.createDataFrame(rows, DOCS + ", n long, phrase string, shard int").repartition(4)


def texts(docs):
    return [(r.lang, r.text) for r in docs.select("lang", "text").collect()]


@pytest.mark.parametrize(
    "how",
    [{}, {"limit": 3, "support": 2}, {"limit": 40, "support": 3}, {"limit": 25, "support": 2, "longest": 5}],
    ids=str,
)
def test_phrases(spark, odd, how):
    """Few wanted phrases end in the first bands, many need all."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for docs in (given, odd):
        got = sorted(tuple(r) for r in collocations.mine(docs, **how).collect())
        assert got == brute.phrases(texts(docs), **how)


def test_phrases_in_small_chunks(spark, odd, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 16)
    got = sorted(tuple(r) for r in collocations.mine(odd, support=3).collect())
    assert got == brute.phrases(texts(odd), support=3)


def test_filters_that_pass_too_much(spark, odd, monkeypatch):
    """Counts that nobody asked for change nothing."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 256)
    got = sorted(tuple(r) for r in collocations.mine(odd, limit=4, support=2).collect())
    assert got == brute.phrases(texts(odd), limit=4, support=2)


VECTORS = "vec_id long, embedding array<float>, label int, q int, block string, tile long"


@pytest.fixture(scope="module")
def vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [((i * 37 + j * j * 11) % 41 - 18) / 16 for j in range(6)], i % 4) for i in range(-40, 460, 3)]
    rows += [(100, [0.5] * 6, 1)] * 3 + [(200, [0.0] * 6, 2), (300, [-1.0] * 6, 3), (700, [1.0, 2.0], 1)]
    rows += [(i, [0.25] * 6, i % 3) for i in range(1000, 1100)]  # one very common vector
    rows += [(500, None, 1), (600, [1.0] * 6, None), (None, [9.0] * 6, 1), (800, [1.0, None] * 3, 1)]
    rows += [(900, [nan] * 6, 1), (400, [inf] * 6, 1), (1400, [], 1), (2100, [1.0, -2.0], 1), (7, [3.0, 4.0], 2)]
    return rows


def mined(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], VECTORS)
    frame.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect())


def test_negatives(spark, tmp_path, vectors):
    assert mined(spark, tmp_path, vectors) == brute.negatives(vectors)


def test_negatives_in_small_blocks(spark, tmp_path, vectors, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("TILE_ANCHORS", 2), ("LANE_BLOCKS", 3), ("BAND_TILES", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, tmp_path, vectors) == brute.negatives(vectors)


def test_negatives_beyond_floats(spark, tmp_path, vectors):
    """Products above 2**53 are exact."""
    large = [(k, v and [x and x * 2.0**20 for x in v], label) for k, v, label in vectors]
    assert mined(spark, tmp_path, large) == brute.negatives(large)


def test_negatives_of_given_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    got = sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, FOLDER).collect())
    assert got == brute.negatives([tuple(r) for r in rows])


def test_zone_maps_leave_blocks_out(spark):
    """Two far clusters: anchors of one read no block of the other."""
    rows = [(i, i % 5, True, [(1000 if i < 2000 else -1000) + (i * j) % 7 for j in range(4)]) for i in range(4000)]
    frame = spark.createDataFrame(rows, "id long, label long, anchor boolean, q array<long>")
    blocks = negatives.write_blocks(frame, negatives.scratch_path(spark, "blocks"))
    tiles = negatives.anchor_tiles(blocks, 5)
    pairs = blocks.count() * tiles.count()
    reads = negatives.plan_reads(blocks, tiles, True, 1, 1).selectExpr("sum(size(reads))").first()[0]
    assert 0 < reads <= 0.6 * pairs


def test_curve_visits_neighbours():
    import numpy as np

    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(negatives.curve_places(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def sharded(spark, tmp_path, docs, name="op13_kd_shards"):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return QUERIES[name](spark, str(tmp_path)).collect()


def check_shards(rows, got, n=8):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (k is None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows
    )
    slots = {}
    for r in got:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op13_kd_shards"](spark, FOLDER).collect()
    check_shards(rows, got)
    expected = brute.kd_shards(rows, 8, shards.WHOLE)
    assert {r.doc_id: r.shard for r in got} == {k: s for (k, _), s in zip(rows, expected)}
    where = {}
    texts = dict(rows)
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    heavy = shards.WHOLE * sum(r.size for r in got) / 8
    for text, places in where.items():  # copies stay together
        assert len(places) == 1 or sum(len(t or "") + 1 for t in texts.values() if t == text) > heavy


def test_shards_of_odd_rows(spark, tmp_path, odd):
    """A third of all bytes in copies of one text; NULLs; one shard more than there are texts."""
    copies = [(1000 + i, "copy " * 100, None, None, None, 1, "", 2) for i in range(300)]
    docs = odd.union(spark.createDataFrame(copies, odd.schema)).unionByName(
        spark.createDataFrame([(None, None, None, None, None, 1, "", 2)] * 2, odd.schema)
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sharded(spark, tmp_path, docs)
    check_shards(rows, got)
    expected = brute.kd_shards(rows, 8, shards.WHOLE)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.shard) for r in got), key=key) == sorted(
        ((k, s) for (k, _), s in zip(rows, expected)), key=key
    )
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) < 1.1 * sum(sizes) / 8


def test_shards_by_target_bytes(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    path = f"{tmp_path}/shards"
    shards.write_shards(docs, path, target_bytes=60_000)
    read = shards.read_shards(docs, path)
    total = read.selectExpr("sum(weight)").first()[0]
    sizes = [r.w for r in read.groupBy("shard").agg({"weight": "sum"}).toDF("shard", "w").collect()]
    assert len(sizes) == round(total / 60_000)
    assert sorted(read.select("doc.*").collect()) == sorted(docs.collect())
