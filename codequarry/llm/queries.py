"""The queries of the numbered operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from codequarry.llm import (
    byte_bpe,
    collocations,
    decontamination,
    language,
    licenses,
    negatives,
    pseudonyms,
    quality,
    shards,
    simhash,
    sketches,
    suffixes,
    token_files,
)
from codequarry.llm.common import letter_crc, query, table
from codequarry.session import scratch_path

SPAN_BYTES = 200
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WINDOW_WORDS = 10
SLOP_WORDS = 5
SHINGLE_WORDS = 3
LINK_BITS = 3
PSEUDONYM_KEY = "codequarry pseudonyms 1"
SHARDS = 8


def documents(spark, folder):
    return table(spark, folder, "documents")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, folder):
    """What is left of every text without its repeated passages of 200 bytes."""
    cut = suffixes.cut_repeats(documents(spark, folder), SPAN_BYTES)
    return cut.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op2_token_files")
def op2_token_files(spark, folder):
    """Every text's ids, written to token files and read back."""
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(documents(spark, folder), path, WORD_TOKENIZER, END_ID)
    read = token_files.read_token_files(spark.read.parquet(path))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_decontamination")
def op3_decontamination(spark, folder):
    """What every text holds of the test items, word for word; ``n_near`` counts items nearly there."""
    found = decontamination.find_passages(
        documents(spark, folder), table(spark, folder, "benchmark"), WINDOW_WORDS, SLOP_WORDS
    )
    n_hit = decontamination.covered()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


@query("op4_language_id")
def op4_language_id(spark, folder):
    """The language of every text, learned from three folds of four."""
    docs = documents(spark, folder)
    held_out = letter_crc("doc_id") % 4 == 2
    model = language.train(language.sample(docs.where(~held_out), "doc_id", "text", "lang"))
    return language.predict(docs, model).select(
        "doc_id", (letter_crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score", "accepted"
    )


@query("op5_pii")
def op5_pii(spark, folder):
    """Every text with its personal data replaced, and how many values were."""
    docs = documents(spark, folder).select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, PSEUDONYM_KEY, count="n_values").select(
        "doc_id", "n_values", "text"
    )


@query("op6_simhash")
def op6_simhash(spark, folder):
    """Every document's fingerprint and the least id that its links reach."""
    found = simhash.near_duplicates(documents(spark, folder), SHINGLE_WORDS, LINK_BITS)
    return found.select(
        "doc_id", simhash.hex_mark("fp").alias("fingerprint"), F.col("component").alias("component_id")
    )


@query("op7_byte_bpe")
def op7_byte_bpe(spark, folder):
    """Every text's ids and what they decode to."""
    pattern = public_tokenizers.PATTERN
    encoded = byte_bpe.encode_texts(documents(spark, folder), BYTE_RANKS, pattern)
    return byte_bpe.decode_ids(encoded, BYTE_RANKS, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def quality_model(docs, labels, fold=lambda crc: crc % 3 != 1):
    """Learned from the labels of the rows in ``fold`` alone."""
    return quality.learn(docs, labels.where(fold(letter_crc("doc_id"))))


@query("op8_quality")
def op8_quality(spark, folder):
    """Every text's quality, learned from the labels of two folds of three."""
    docs = documents(spark, folder)
    model = quality_model(docs, table(spark, folder, "labels"))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        (letter_crc("doc_id") % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op9_licenses")
def op9_licenses(spark, folder):
    """The license phrases and notices of every text."""
    return licenses.scan(documents(spark, folder))


@query("op10_sketches")
def op10_sketches(spark, folder):
    """Every text's sketch beside those of its edited text and of the next text."""
    return sketches.compare_with_next(documents(spark, folder))


_PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
  SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i
  FROM listed, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cuts AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:k], ' ')
            JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:cuts.m], ' ')),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i
          FROM (SELECT *, unnest(range(2, m)) AS s FROM c WHERE m > 2)),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS cover FROM spans GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase)
         WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op11_collocations", _PHRASES_SQL)
def op11_collocations(spark, folder):
    """The best phrases of each language, from all texts."""
    return collocations.mine(documents(spark, folder))


_NEGATIVES_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def op12_hard_negatives(spark, folder):
    """Rows of other labels that score a little less than an anchor's positives."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, moved)


@query("op13_kd_shards")
def op13_kd_shards(spark, folder):
    """Every document in one of eight shards of near equal bytes, written and read back."""
    docs = documents(spark, folder)
    path = scratch_path(spark, "shards")
    shards.write_shards(docs, path, SHARDS)
    return shards.read_shards(docs, path).select(
        "doc.doc_id",
        F.col("weight").alias("size"),
        F.crc32(F.coalesce("doc.text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
