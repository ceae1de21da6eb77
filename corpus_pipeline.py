"""A training corpus from ``documents``: five stages, each one of the operators.

``STAGES`` names them in order. Each takes the rows that the one before kept
and is written as Parquet before the next begins, so a lost executor costs no
more than the stage it was in. All but the last return the columns of
``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import byte_bpe, decontamination, pseudonyms, quality, queries, simhash
from codequarry.session import scratch_path, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects (a score below 1/2).

    It learns from the labels of documents that are here; with none it rejects
    nothing. Rows are scored and filtered as they are, so no join is needed.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    model = queries.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id.

    Rows of one id are told apart by their place. Documents without an id are
    kept: they have no name to choose by.
    """
    ship_package(spark)
    return simhash.keep_first(docs.select(*COLUMNS), queries.SHINGLE_WORDS, queries.LINK_BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a window of a benchmark item."""
    ship_package(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_passages(docs.select(*COLUMNS), items, queries.WINDOW_WORDS)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format."""
    ship_package(spark)
    hidden = pseudonyms.pseudonymize(docs.select(*COLUMNS), queries.PSEUDONYM_KEY)
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (little-endian, 32 bits each) and their number.

    Ids are decoded again and must give the text; a difference ends the job.
    """
    ship_package(spark)
    return byte_bpe.with_ids(docs.select(*COLUMNS), queries.BYTE_RANKS, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("PII", hide_personal),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
