"""TF-IDF weights in long form and as hashed sparse vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import (
    IDF,
    ElementwiseProduct,
    HashingTF,
    IDFModel,
    Normalizer,
    RegexTokenizer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codequarry.operators.rows import with_row_index
from codequarry.session import stored

# Fixed value: a token is a run of two or more word characters, any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Postings of one term that one task is to hold; a term with more stays where its texts are.
SHARD_POSTINGS = 1_000_000
# So do the most frequent terms, as many as this, of at most so many characters: their idf is broadcast.
COMMON_TERMS = 1 << 16
COMMON_LENGTH = 64


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf). All words of a text are in its row, so nothing shuffles.

    Sorting the words puts equal ones next to each other; where a run starts
    and where the next one starts give its length.
    """
    words = df.select(id_col, F.sort_array(tokens(F.col(text))).alias("w"))
    # An array is not a cheap expression, so Spark keeps these steps apart
    # and sorts once per row.
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
    starts = words.withColumn(
        "s", F.filter(places, lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    )
    runs = F.transform(
        "s",
        lambda start, i: F.struct(
            F.get("w", start).alias("term"),
            (F.coalesce(F.get("s", i + 1), F.size("w")) - start).alias("tf"),
        ),
    )
    # A term is never NULL; saying so makes the plans of all readers alike, and
    # Spark then computes what they share once.
    return starts.select(id_col, F.inline(runs)).where("term IS NOT NULL")


def document_counts(postings: DataFrame) -> DataFrame:
    """(term, df): in how many texts a term occurs."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def counted(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, term, tf) and (term, df, idf), both as written to the shared folder.

    ``idf = ln((1 + n) / (1 + df)) + 1``; n counts every text, also one with no
    terms. Texts are read and parted once; document counts come from the copy.
    """
    postings = stored(term_counts(df, id_col, text), "counts")
    total = df.agg(F.count("*")).scalar()
    idf = F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0
    return postings, stored(document_counts(postings).withColumn("idf", idf), "idf")


def weighed(postings: DataFrame, terms: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """``postings`` with the columns of their ``terms`` (term, df, idf, ...) and raw = tf * idf.

    Most postings are of few terms. Those terms are sent to the postings, a
    table of bounded size, in which every term is that has more postings than
    a task is to hold; only the postings of rarer terms move.
    """
    hot = F.col("df") > SHARD_POSTINGS
    frequent = terms.where(~hot & (F.length("term") <= COMMON_LENGTH)).orderBy(F.desc("df"), "term").limit(COMMON_TERMS)
    common = stored(terms.where(hot).unionByName(frequent), "common")
    if scratch is not None:
        scratch.append(common)
    here = postings.join(F.broadcast(common), "term")
    rare = postings.join(F.broadcast(common.select("term")), "term", "left_anti").join(terms, "term")
    return here.unionByName(rare).withColumn("raw", F.col("tf") * F.col("idf"))


def tfidf(df: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, term, weight) with smoothed idf and rows of length one.

    Rare postings move to meet their term's idf, and all of them to be scaled
    by their text's length.
    """
    raw = weighed(*counted(df, id_col, text))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("raw") / norm).alias("weight"))


def numbered_rows(
    df: DataFrame, id_col: str, text: str, scratch: list[DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(id, columns, weights) of texts with terms, and the vocabulary (term, df, idf, column).

    Weights are those of :func:`tfidf`, in the order of the columns, which are
    in that of the terms. Texts of one id are a row together. Squares are
    added in that order too, so equal texts have equal weights to the last
    digit. The tables that the two are read from are added to ``scratch``, for
    callers that write both and need these no more.
    """
    postings, terms = counted(df, id_col, text)
    place = F.col("column").cast("int")
    vocabulary = stored(with_row_index(terms, ["term"], "column").withColumn("column", place), "vocabulary")
    raw = weighed(postings, vocabulary, scratch)
    if scratch is not None:
        scratch += [postings, terms, vocabulary]
    cells = F.sort_array(F.collect_list(F.struct("column", "raw")))  # the words of one text
    squares = F.aggregate("c.raw", F.lit(0.0), lambda total, own: total + own * own)
    rows = raw.groupBy(id_col).agg(cells.alias("c"))
    # The length is an element of an array, so that Spark works it out once a row, not once a word.
    weights = F.transform(F.array(F.sqrt(squares)), lambda norm: F.transform("c.raw", lambda own: own / norm))
    return rows.select(id_col, F.col("c.column").alias("columns"), weights[0].alias("weights")), vocabulary


def tfidf_vectors(
    df: DataFrame, id_col: str = "id", text: str = "text", out: str = "features"
) -> tuple[DataFrame, DataFrame]:
    """((id, sparse vector), (term, column)): a column for every term of the corpus.

    Columns are numbered in the order of the terms. A text without terms has
    an empty vector.
    """
    rows, vocabulary = numbered_rows(df, id_col, text)
    width = vocabulary.count()
    every = df.select(id_col).join(rows, id_col, "left").select(
        id_col,
        F.coalesce(F.col("columns"), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.col("weights"), F.array().cast("array<double>")).alias("values"),
    )
    schema = T.StructType([df.schema[id_col], T.StructField(out, VectorUDT())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            kind, size = pa.array([0] * n, pa.int8()), pa.array([width] * n, pa.int32())
            vector = pa.StructArray.from_arrays(
                [kind, size, batch.column(1), batch.column(2)],
                names=["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), vector], names=[id_col, out])

    return every.mapInArrow(build, schema), vocabulary.select("term", F.col("column").cast("long").alias("column"))


@dataclass
class HashedTfidf:
    """A fitted hashed TF-IDF: the same weights, terms hashed to ``dim`` columns.

    Row-local and native once fitted; the only aggregate is the document count
    per column, ``dim`` numbers.
    """

    dim: int
    idf: IDFModel

    def transform(self, df: DataFrame, text: str, out: str = "features") -> DataFrame:
        # Spark's idf lacks the closing + 1, so it is added to each factor.
        factors = Vectors.dense(self.idf.idf.toArray() + 1.0)
        scale = ElementwiseProduct(scalingVec=factors, inputCol="_tf", outputCol="_scaled")
        scaled = scale.transform(_hashed(df, text, self.dim))
        rows = Normalizer(inputCol="_scaled", outputCol=out).transform(scaled)
        return rows.drop("_words", "_tf", "_scaled")


def _hashed(df: DataFrame, text: str, dim: int) -> DataFrame:
    split = RegexTokenizer(
        gaps=False, pattern=TOKEN_PATTERN, toLowercase=True, inputCol=text, outputCol="_words"
    )
    return HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(
        split.transform(df)
    )


def fit_hashed_tfidf(df: DataFrame, text: str = "text", dim: int = 1 << 14) -> HashedTfidf:
    """Count documents per hashed column over the whole table."""
    hashed = _hashed(df.select(text), text, dim)
    return HashedTfidf(dim, IDF(inputCol="_tf", outputCol="_unused").fit(hashed))


def hash_embed(
    model: HashedTfidf, df: DataFrame, text: str = "text", out: str = "vec"
) -> DataFrame:
    """Dense ``array<float>`` text vectors, a stand-in where no model is at hand."""
    rows = model.transform(df, text, "_features")
    return rows.withColumn(out, vector_to_array("_features", "float32")).drop("_features")
