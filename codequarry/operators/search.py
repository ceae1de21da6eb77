"""Nearest and farthest vectors, one query or many, and search by text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import search_text
from codequarry.functions.vectors import measure, measure_to, metric_kernel
from codequarry.operators.joins import pair_vectors
from codequarry.operators.pivots import knn_join
from codequarry.session import durable

# Results shown for a snippet, for a dot-product ranking, for a
# search on whole vectors and for a search on latent points.
TOP_SIMILAR = 10
TOP_DOT = 5
TOP_FULL = 100
TOP_LATENT = 500


def query_vector(df: DataFrame, key, id_col: str = "id", vec: str = "vec") -> list[float]:
    """The vector of one id; the lookup reaches the parquet scan."""
    row = df.where(F.col(id_col) == F.lit(key)).select(vec).first()
    if row is None or row[0] is None:
        raise KeyError(f"no vector with {id_col} = {key!r}")
    return list(row[0])


def knn(
    df: DataFrame,
    query: Sequence[float],
    k: int = TOP_SIMILAR,
    metric: str = "cosine",
    p: float = 2.0,
    farthest: bool = False,
    id_col: str = "id",
    vec: str = "vec",
) -> DataFrame:
    """(id, score) of the ``k`` nearest rows, or of the ``k`` farthest.

    The query travels with the scoring function, so nothing is joined. Each
    task keeps its own best ``k``; only those meet. Rows with no score
    (another length, a zero vector under cosine) are left out.
    """
    _, larger_is_nearer = metric_kernel(metric, p)
    scored = df.select(id_col, measure_to(F.col(vec), list(query), metric, p).alias("score"))
    descending = larger_is_nearer != farthest
    best = F.desc_nulls_last("score") if descending else F.asc_nulls_last("score")
    # Tested after the cut: a test before it would have Spark score rows twice.
    return scored.orderBy(best, id_col).limit(k).where("score IS NOT NULL")


def knn_hydrated(
    vectors: DataFrame,
    texts: DataFrame,
    query: Sequence[float],
    k: int = TOP_SIMILAR,
    metric: str = "cosine",
    p: float = 2.0,
    farthest: bool = False,
    id_col: str = "id",
    vec: str = "vec",
) -> DataFrame:
    """:func:`knn` with the columns of ``texts``; an id without text keeps NULLs.

    The winners, k rows, are broadcast to the texts, which do not move.
    """
    winners = durable(knn(vectors, query, k, metric, p, farthest, id_col, vec))
    return _attach(winners, [texts], id_col)


def _attach(winners: DataFrame, tables: Sequence[DataFrame], id_col: str) -> DataFrame:
    """Winners with the columns of each table, NULL where it lacks an id.

    Each table is cut down to the winners' ids by a join they are broadcast
    into: they are the k rows of a limit.
    """
    out = winners
    for table in tables:
        wanted = table.join(F.broadcast(winners.select(id_col)), id_col, "left_semi")
        out = out.join(wanted, id_col, "left")
    return out


def knn_batch(
    df: DataFrame,
    queries: DataFrame,
    k: int = TOP_SIMILAR,
    metric: str = "cosine",
    p: float = 2.0,
    id_col: str = "id",
    vec: str = "vec",
) -> DataFrame:
    """(qid, id, score, rank): the ``k`` nearest rows to each of many queries (qid, qvec).

    An exact join by distances to pivots, see :func:`pivots.knn_join`.
    """
    return knn_join(df, queries, k, metric, p, id_col, vec)


def pairwise_similarity(
    a: DataFrame,
    b: DataFrame,
    key: str = "id",
    metric: str = "cosine",
    p: float = 2.0,
    vec: str = "vec",
) -> DataFrame:
    """(key, score) of the vectors two tables hold under the same key."""
    pairs = pair_vectors(a, b, key, vec)
    return pairs.select(key, measure(F.col("a"), F.col("b"), metric, p).alias("score"))


def text_search(
    vectors: DataFrame,
    text: str,
    embed: Callable[[DataFrame, str, str], DataFrame],
    k: int = TOP_FULL,
    metric: str = "minkowski",
    p: float = 2.0,
    attach: Sequence[DataFrame] = (),
    id_col: str = "id",
    vec: str = "vec",
) -> DataFrame:
    """Rows nearest to a typed text, with coordinates, clusters or bodies attached.

    ``embed(df, text_column, vector_column)`` is the model that made
    ``vectors``. A blank text finds nothing. All rows are searched.
    """
    spark = vectors.sparkSession
    typed = spark.createDataFrame([(text,)], "text string")
    typed = typed.select(search_text(F.col("text")).alias("text")).where("text IS NOT NULL")
    row = embed(typed, "text", "vec").select("vec").first()
    if row is None:
        found = knn(vectors.limit(0), [0.0], 1, metric, p, False, id_col, vec)
    else:
        found = knn(vectors, row.vec, k, metric, p, False, id_col, vec)
    return _attach(durable(found), attach, id_col) if attach else found
