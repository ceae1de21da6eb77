"""The numbered queries against plain Python, on whole small tables and on hostile rows."""

from __future__ import annotations

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from codequarry.llm import byte_bpe, decontamination, licenses, queries, simhash, suffixes, token_files
from codequarry.llm.common import load
from codequarry.session import scratch_path
from tests.llm import brute

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: entry.run for name, entry in load().items()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    """A folder of tables with NULLs, empties, ties, repeats, long texts and clashing columns."""
    folder = str(tmp_path_factory.mktemp("hostile"))
    spark.read.parquet(f"{FOLDER}/documents.parquet").createOrReplaceTempView("given")
    given = [r.text for r in spark.sql("select text from given order by doc_id limit 40").collect()]
    passage = given[3][:150] * 2
    long = "x" * 30_000 + " " + " ".join(given) * 2
    texts = [
        None, "", " ", "\n\n  \t ", "a", "A b", "a b c", given[0], given[0], given[0] + ".",
        passage, passage + "!", "q" + passage, "é" * 500, "é" * 499 + "e", "ab" * 400,
        long, long + "z", long[:-5], "under the MIT License", "UNDER THE MIT LICENSE. cc by nc cc-by-nc",
        "Apache License, Version 2.0", "apache license version 2", "Iİıſ Kelvin K", "a\u0000b" * 90,
        "token <|endoftext|> x<|startoftext|>y", "it's we'll 3½ ①  two  spaces\n and\r\n ends ", "\x1c\x1d sep\x85arator",
        "漢字 かな 한글 🙂🙂 " * 20, "1 2 3 4 5 6 7 8 9 10 11", *given,
    ]
    rows = [(i * 3 - 7, t, "en" if i % 3 else None, "s", 0, i, i, "w") for i, t in enumerate(texts)]
    schema = SCHEMA + ", fp long, part int, words string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    items = [
        (0, None), (1, ""), (2, given[0]), (2, given[0]), (10, "1 2 3"), (9, " ".join(given[5].split()[2:14])),
        (11, "q" + passage), (12, "a b"), (13, "K"),
    ]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], r[0] % 2, None) for r in rows] + [(None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    return folder


@pytest.fixture(scope="module", params=["given", "hostile"])
def tables(request, spark):
    folder = FOLDER if request.param == "given" else request.getfixturevalue("hostile")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    return folder, rows, items


def result(spark, name, folder, columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect())


def test_op1(spark, tables):
    folder, rows, _ = tables
    expected = [(k, *x) for (k, _), x in zip(rows, brute.repeats([t for _, t in rows], 200))]
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert result(spark, "op1_suffix_dedup", folder, columns) == sorted(expected)


def test_op2(spark, tables):
    folder, rows, _ = tables
    expected = brute.tokens(rows, queries.WORD_TOKENIZER, queries.END_ID)
    columns = "doc_id", "start", "n_tokens", "ids_crc32"
    assert result(spark, "op2_token_files", folder, columns) == expected


def test_words_against_the_library():
    """Capitals, special tokens, marks and scripts, in any order."""
    import random
    import struct

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    own = token_files.WordEncoder(queries.WORD_TOKENIZER)
    bits = "Hello|World|<\x7c|\x7c>|<\x7cendoftext\x7c>|<\x7cENDOFTEXT\x7c>|<\x7cstartoftext\x7c>| |\n|  |\t|'s|'LL|it's|E\u0301"
    bits += "|É|A\u030a|I\u0307|İ|ı|ſ|\u212a|ß|ẞ|漢|🙂|½|①|1|23|.|--|\u0301|\xa0|\x1c|\x85|ΑΣ|ς|a|B|<|>|ﬁ|ǅ"
    bits = [b.replace("\x7c", "|") for b in bits.replace("<\x7c", "<\0").replace("\x7c>", "\0>").split("|")]
    bits = [b.replace("\0", "|") for b in bits]
    assert "<|endoftext|>" in bits and "<|" in bits
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 9)))
        ids = own.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode(text, add_special_tokens=False).ids, text


def test_simple_words_ask_the_model_alone():
    """Words of letters, digits and marks need nothing else of the library, however many ids they have."""
    own, plain = (token_files.WordEncoder(queries.WORD_TOKENIZER) for _ in range(2))
    text = "Some words, 2 of them l\u00e4nger " + "zqxj" * 40
    ids = plain.tokenizer.encode(text, add_special_tokens=False).ids
    own.tokenizer = None
    assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids) and len(ids) > 40


def test_another_tokenizer_gets_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = token_files.WordEncoder(path), Tokenizer.from_file(path)
    text = "Hello  World\n\n don't <|endoftext|> É 123"
    assert not own.by_words
    assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text).ids)


@pytest.mark.parametrize("children", [2, 3, 32])
def test_trees_of_any_width(monkeypatch, children):
    """The leftmost pair of least rank is merged, however many levels the tree has."""
    monkeypatch.setattr(byte_bpe, "FAN", children)
    rng = np.random.default_rng(6)
    ranks = byte_bpe.read_ranks(queries.BYTE_RANKS)
    for size in (1, 2, 3, 9, 32, 33, 100, 1100):
        for letters in (b"a", b"the an", bytes(range(256))):
            piece = bytes(rng.choice(list(letters), size).tolist())
            parts = [piece] if piece in ranks else [piece[i : i + 1] for i in range(size)]
            while True:
                pairs = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
                if not pairs or min(pairs) == 1 << 40:
                    break
                at = pairs.index(min(pairs))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            assert byte_bpe.merge_piece(piece, ranks) == [ranks[part] for part in parts]


def test_another_pattern_is_matched_whole():
    pattern = r"\S+\s*|\s+"
    ranks = byte_bpe.read_ranks(queries.BYTE_RANKS)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.Codec(queries.BYTE_RANKS, pattern)
    for text in ("a b  c", "one two three", " lead and trail "):
        ids = library.encode_ordinary(text)
        assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_memos_hold_few_bytes():
    from codequarry.llm.common import Recent

    memo = Recent(lambda x: x * 2, 20_000)
    for i in range(5_000):
        assert memo[f"{i % 700}"] == f"{i % 700}" * 2 and memo["x" * (300 + i % 3)] == "x" * (600 + 2 * (i % 3))
    assert len(memo) + len(memo.old) <= 2 * 20_000 / Recent.ENTRY + 2 and not any(len(x) > 256 for x in memo)


@pytest.mark.parametrize("wide", [False, True])
def test_packed_ids(wide):
    """Outliers of 32 bits, block edges, and parts by block."""
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (0, 1, 127, 128, 129, 1000):
        ids = rng.integers(0, 60_000, n).astype(np.uint32)
        if wide and n:
            ids[rng.integers(0, n, n // 9 + 1)] = 2**32 - 1
        packed = token_files.pack(ids)
        assert (token_files.unpack(packed) == ids).all()
        for first in range(0, -(-n // 128) + 1, 3):
            assert (token_files.unpack(packed, first, first + 2) == ids[first * 128 : (first + 2) * 128]).all()


def test_op3(spark, tables):
    folder, rows, items = tables
    expected = sorted(brute.contamination(rows, items, 10))
    columns = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    assert result(spark, "op3_decontamination", folder, columns) == expected
    near = sorted(brute.near_items(rows, items, 10, queries.SLOP_WORDS))
    assert result(spark, "op3_decontamination", folder, ["doc_id", "n_near"]) == near


@pytest.mark.parametrize("words", [1 << 19, 4])
def test_op3_rows_of_equal_and_null_keys(spark, monkeypatch, words):
    """One block of test items or many, the same rows; the index is asked twice."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", words)
    rows = [(1, "a b c d e f"), (1, "x a b c y d e f"), (None, "d e f a c b"), (None, None), (2, "c b a")]
    items = [(1, "a b c d"), (2, "d e f"), (3, "z z z"), (4, "c d"), (None, "e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    index = decontamination.write_index(docs, scratch_path(spark, "postings"))
    for slop in (None, 1):
        found = decontamination.search_index(index, tests, 3, slop)
        got = sorted(((r.doc_id, r.n_words, r.starts, r.stops, r.items, r.near) for r in found.collect()), key=str)
        near = [["", "1", "2", "4"], ["", "1", "2", "4"], ["", "1", "2"], [], ["1"]] if slop else [[]] * 5
        assert got == sorted(
            [
                (1, 6, [0], [6], ["", "1", "2", "4"], near[0]),
                (1, 8, [1, 5], [4, 8], ["", "1", "2"], near[1]),
                (None, 6, [0], [3], ["", "2"], near[2]),
                (None, 0, [], [], [], near[3]),
                (2, 3, [], [], [], near[4]),
            ],
            key=str,
        )


@pytest.mark.parametrize("pairs", [1 << 19, 3])
def test_op3_every_window_is_looked_for_nearby(spark, monkeypatch, pairs):
    """Windows anywhere in an item, against plain Python given each of them as an item."""
    monkeypatch.setattr(decontamination, "NEAR_PAIRS", pairs, raising=False)
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(rng.choice(list("abcdefghijkl"), n))
    items = [(i, words(n)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 7, 9, 11, 13])] + [(77, "m n o p q r s"), (9, "a a b a")]
    rows = [(i, words(n)) for i, n in enumerate([0, 3, 5, 8, 13, 40, 90, 200])]
    rows += [(1, "x n p y o z"), (None, "o x n p"), (None, None), (50, "m n o"), (51, "n x x x p o")]
    windows = [(i, " ".join(t.split()[at : at + 3])) for i, t in items for at in range(max(1, len(t.split()) - 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_passages(docs, tests, 3, 2).collect()
    near = sorted(((r.doc_id, len(r.near)) for r in found), key=str)
    assert near == sorted(brute.near_items(rows, windows, 3, 2), key=str)
    assert [r.near for r in found if r.doc_id == 1 and r.n_words == 6] == [["77"]]  # n o p is no tile of the item


def test_op4(spark, tables):
    folder, rows, _ = tables
    got = result(spark, "op4_language_id", folder, ["doc_id", "held_out", "lang_pred", "score"])
    assert [r[0] for r in got] == sorted(k for k, _ in rows)
    texts = dict(rows)
    langs = {r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()} - {None}
    for key, held_out, lang, score in got:
        assert held_out == (zlib.crc32(str(key).encode()) % 4 == 2)
        letters = any(c.isalpha() for c in texts[key] or "")
        assert (lang in langs if letters else lang == "und") and 0 <= score <= 1


def test_op5(spark, tables):
    """Every row once; what has neither digit nor @ is as it was, and what is counted is changed."""
    folder, rows, _ = tables
    got = QUERIES["op5_pii"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in rows)
    texts = dict(rows)
    for r in got:
        assert (r.text != texts[r.doc_id]) == (r.n_values > 0) and (r.text is None) == (texts[r.doc_id] is None)
        if not any(c.isdigit() or c == "@" for c in r.text or ""):
            assert r.n_values == 0


def test_op6(spark, tables):
    folder, rows, _ = tables
    expected = sorted(brute.near_duplicates(rows, 3, 3))
    assert result(spark, "op6_simhash", folder, ["doc_id", "fingerprint", "component_id"]) == expected


def test_op7(spark, tables):
    folder, rows, _ = tables
    ranks = byte_bpe.read_ranks(queries.BYTE_RANKS)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    expected = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        expected.append((key, len(ids), brute.sha(data), brute.sha((text or "").encode())))
    columns = "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    assert result(spark, "op7_byte_bpe", folder, columns) == sorted(expected)


def test_op8(spark, tables):
    folder, rows, _ = tables
    got = result(spark, "op8_quality", folder, ["doc_id", "held_out", "score", "predicted"])
    assert [r[0] for r in got] == sorted(k for k, _ in rows)
    for key, held_out, score, predicted in got:
        assert held_out == (zlib.crc32(str(key).encode()) % 3 == 1)
        assert 0 <= score <= 1 and predicted == (score >= 0.5)


def test_op9(spark, tables):
    folder, rows, _ = tables
    got = QUERIES["op9_licenses"](spark, folder).collect()
    base = sorted(
        (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got
    )
    key = lambda r: r[0]
    assert base == sorted(brute.licenses(rows, licenses.PHRASES), key=key)
    texts = dict(rows)
    for r in got:
        labels, score = brute.notice_labels(
            texts[r.doc_id], licenses.TEMPLATES, licenses.GRAM, licenses.NEAR, licenses.COVERED
        )
        assert r.labels == ",".join(sorted(labels)) and r.score == pytest.approx(score)


def test_op9_repeated_and_changed_notices(spark):
    notice = " ".join(licenses.NOTICES[1][1].split())
    changed = notice.replace("free of charge ", "wholly free of any charge ").replace("documentation ", "")
    texts = ["all rights reserved " * n for n in (1, 2, 3, 8, 500)]
    texts += [notice, notice.upper() + ". " + notice, changed, " ".join(notice.split()[::2]), notice[:60], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].labels for i in range(len(texts))] == ["proprietary"] * 5 + ["mit"] * 3 + [""] * 3
    spans = licenses.spans(licenses.hits(docs.where("doc_id = 4"))).count()
    assert spans == 500 and got[7].score < 1 == got[6].score


def test_op10(spark, tables):
    folder, rows, _ = tables
    got = QUERIES["op10_sketches"](spark, folder).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute.edits(rows)
    order = sorted(got, key=lambda r: r.doc_id)
    texts = dict(rows)
    marks = {}
    for r, after in zip(order, order[1:] + order[:1]):
        assert marks.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
        a, b = set(r.fingerprint), set(after.fingerprint)
        assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        e = set(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(len(a & e) / len(a | e) if a | e else 1.0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op11_collocations", "op12_hard_negatives"}))
def test_repeated_and_null_keys(spark, name, tmp_path):
    rows = [(None, "a b c d", None, None, None)] * 2 + [(1, "x y z", "en", None, None)] * 3
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "a b"), (1, "x y")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    assert QUERIES[name](spark, str(tmp_path)).count() == len(rows)


def test_links_survive_blocks(spark, monkeypatch):
    """A crowd of fingerprints that differ in few bits, in blocks far smaller than the crowd."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    marks = [0x5A5A_0000_1111_2222 ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(a)]
    frame = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in sorted(set(marks))], "fp long")
    stars = simhash.components(simhash.links(frame, simhash.Ring(3, 8))).collect()
    assert len(stars) == frame.count() - 1 and len({r.root for r in stars}) == 1


def test_large_families_are_parted(spark, monkeypatch):
    """Passages of one family in many surroundings, refined until few meet."""
    monkeypatch.setattr(suffixes, "FAMILY", 3)
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(90))
    texts = [f"{i * 7919 % 97:03d}" * 25 + passage + f"{i * 31 % 23:02d}" * 30 for i in range(60)]
    texts += texts[:5] + [passage * 3, "z" * 400]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.cut_repeats(frame, 100).collect()
    expected = brute.repeats(texts, 100)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), brute.sha(bytes(r.kept))) for r in got) == [
        (i, *x) for i, x in enumerate(expected)
    ]
