"""The pipeline against the stages worked out one by one in plain Python."""

from __future__ import annotations

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from codequarry.llm import byte_bpe, pseudonyms, queries
from codequarry.llm.common import load
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_stages_are_those_asked_for():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality classifier",
        "SimHash near-dedup",
        "benchmark decontamination",
        "PII",
        "byte-level BPE",
    ]


def test_run(spark, documents):
    scores = load()["op8_quality"].run(spark, FOLDER).collect()
    rows = [(r.doc_id, documents[r.doc_id].text) for r in scores if r.predicted]
    assert 0 < len(rows) < len(documents)
    groups = brute.near_duplicates(rows, 3, 3)
    kept = {key for key, _, low in groups if key == low}
    rows = [r for r in rows if r[0] in kept]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute.contamination(rows, items, 10) if r[-1]}
    assert bad
    rows = [r for r in rows if r[0] not in bad]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hidden = {r.doc_id: r.text for r in pseudonyms.pseudonymize(frame, queries.PSEUDONYM_KEY).collect()}
    assert any(hidden[k] != t for k, t in rows)
    library = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=byte_bpe.read_ranks(queries.BYTE_RANKS),
        special_tokens={},
    )
    result = corpus_pipeline.run(spark, FOLDER)
    assert result.columns == [*corpus_pipeline.COLUMNS, "n_tokens", "ids"]
    found = {r.doc_id: r for r in result.collect()}
    assert found.keys() == hidden.keys()
    for key, row in found.items():
        ids = library.encode_ordinary(hidden[key])
        assert row.text == hidden[key] and row.n_chars == len(row.text)
        assert bytes(row.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and row.n_tokens == len(ids)
        assert (row.lang, row.source) == (documents[key].lang, documents[key].source)


def test_hostile_rows_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, ids string"
    texts = [None, "", " ", "a", "a", "x" * 50_000, "one two three four", None]
    rows = [(None if i == 7 else i, t, None, None, None, None, i, "w") for i, t in enumerate(texts)]
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        own = stage(spark, spark.createDataFrame(rows, schema), str(tmp_path))
        assert own.columns[:5] == list(corpus_pipeline.COLUMNS), name
        kept = own.count()
        # NULL, empty and blank texts have one fingerprint, and so have the two of "a"
        assert kept == {"SimHash near-dedup": 5}.get(name, len(rows)), name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_near_duplicates_are_told_apart_by_row(spark, tmp_path):
    t, u = "one text of some words that is told twice", "another text that has nothing in common with it"
    rows = [(5, t), (5, t), (3, u), (7, u), (7, "a third text, of which there is only one"), (None, u), (None, "x y z")]
    docs = spark.createDataFrame([(k, x, None, None, 0) for k, x in rows], SCHEMA).repartition(3)
    kept = stage("SimHash near-dedup")(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(5, t), (3, u), (7, rows[4][1]), (None, u), (None, "x y z")], key=str
    )


def test_contaminated_rows_without_ids_go(spark, tmp_path):
    spark.createDataFrame([(1, "q w e r t y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "so q w e r t y it is"), (None, "clean"), (4, "Q W E R T Y"), (4, "clean too"), (None, None)]
    docs = spark.createDataFrame([(k, x, None, None, 0) for k, x in rows], SCHEMA)
    kept = stage("benchmark decontamination")(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
