"""Vector measures and similarity search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.catalog import query, r6, spread, table, vectors
from codequarry.functions import vectors as V
from codequarry.operators import search as S
from codequarry.operators.pivots import build_index
from codequarry.session import durable, scratch_path
from codequarry.operators.aggregates import histogram
from codequarry.operators.clustering import cluster_profile
from codequarry.operators.tfidf import fit_hashed_tfidf, hash_embed

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"


def _scores(found):
    return found.select("id", r6("score").alias("score"))


def _knn_sql(score: str, direction: str, k: int, extra: str = "") -> str:
    return f"""WITH s AS (SELECT vec_id AS id, {score} AS score FROM embeddings),
        t AS (SELECT * FROM s ORDER BY score {direction}, id LIMIT {k})
        SELECT id, round(score, 6) + 0e0 AS score FROM t {extra}"""


@query(
    "knn_cosine",
    _knn_sql(f"list_cosine_similarity(embedding::DOUBLE[], {_Q.format(1)})", "DESC", 10),
)
def knn_cosine(spark, folder):
    points = vectors(spark, folder)
    return _scores(S.knn(points, S.query_vector(points, 1)))


@query(
    "knn_farthest",
    _knn_sql(f"list_cosine_similarity(embedding::DOUBLE[], {_Q.format(1)})", "ASC", 10),
)
def knn_farthest(spark, folder):
    points = vectors(spark, folder)
    return _scores(S.knn(points, S.query_vector(points, 1), farthest=True))


@query(
    "knn_dot", _knn_sql(f"list_dot_product(embedding::DOUBLE[], {_Q.format(0)})", "DESC", 5)
)
def knn_dot(spark, folder):
    points = vectors(spark, folder)
    return _scores(S.knn(points, S.query_vector(points, 0), S.TOP_DOT, "dot"))


def _minkowski_sql(a: str, b: str, p: float) -> str:
    return (
        f"pow(list_sum(list_transform(list_zip({a}, {b}), "
        f"lambda z: pow(abs(z[1] - z[2]), {p}))), 1.0 / {p})"
    )


@query(
    "knn_minkowski_p3",
    _knn_sql(_minkowski_sql("embedding::DOUBLE[]", _Q.format(0), 3.0), "ASC", 100),
)
def knn_minkowski_p3(spark, folder):
    points = vectors(spark, folder)
    query_point = S.query_vector(points, 0)
    return _scores(S.knn(points, query_point, S.TOP_FULL, "minkowski", p=3.0))


@query(
    "knn_minkowski_half",
    _knn_sql(_minkowski_sql("embedding::DOUBLE[]", _Q.format(0), 0.5), "ASC", 100),
)
def knn_minkowski_half(spark, folder):
    points = vectors(spark, folder)
    query_point = S.query_vector(points, 0)
    return _scores(S.knn(points, query_point, S.TOP_FULL, "minkowski", p=0.5))


@query(
    "knn_latent_l2",
    _knn_sql(
        f"list_distance((embedding::DOUBLE[])[1:3], {_Q.format(0)}[1:3])", "ASC", S.TOP_LATENT
    ),
)
def knn_latent_l2(spark, folder):
    points = vectors(spark, folder).select("id", F.slice("vec", 1, 3).alias("vec"))
    return _scores(S.knn(points, S.query_vector(points, 0), S.TOP_LATENT, "l2"))


def _index(spark, points, metric, p=2.0):
    return build_index(points, scratch_path(spark, "index"), metric, p)


@query(
    "knn_pivots_latent",
    _knn_sql(
        f"list_distance((embedding::DOUBLE[])[1:3], {_Q.format(0)}[1:3])", "ASC", S.TOP_LATENT
    ),
)
def knn_pivots_latent(spark, folder):
    """The latent search on a stored index of distances to pivots."""
    points = vectors(spark, folder).select("id", F.slice("vec", 1, 3).alias("vec"))
    return _scores(_index(spark, points, "l2").knn(S.query_vector(points, 0), S.TOP_LATENT))


@query(
    "knn_pivots_p3",
    _knn_sql(_minkowski_sql("embedding::DOUBLE[]", _Q.format(0), 3.0), "ASC", 100),
)
def knn_pivots_p3(spark, folder):
    points = vectors(spark, folder)
    return _scores(_index(spark, points, "minkowski", 3.0).knn(S.query_vector(points, 0), S.TOP_FULL))


@query("knn_pivots_skipped")
def knn_pivots_skipped(spark, folder):
    """How many rows of the latent index a search for ten leaves unread."""
    points = vectors(spark, folder).select("id", F.slice("vec", 1, 3).alias("vec"))
    return _index(spark, points, "l2").skipped(S.query_vector(points, 0), S.TOP_SIMILAR)


@query(
    "knn_join",
    """WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id,
                         list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
                  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
       SELECT qid, id, round(score, 6) + 0e0 AS score,
              row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank
       FROM s QUALIFY rank <= 5""",
)
def knn_join(spark, folder):
    """Every vector's nearest others: as many queries as rows."""
    points = vectors(spark, folder)
    found = S.knn_batch(points, points.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), 6, "l2")
    others = found.where("qid <> id")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))
    return others.withColumn("rank", rank).where("rank <= 5").select(
        "qid", "id", r6("score").alias("score"), F.col("rank").cast("bigint")
    )


@query(
    "knn_hydrated",
    f"""WITH s AS (SELECT vec_id AS id,
                         list_cosine_similarity(embedding::DOUBLE[], {_Q.format(1)}) AS score
                  FROM embeddings),
             t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 10)
        SELECT id, round(score, 6) + 0e0 AS score, lang, text
        FROM t LEFT JOIN documents ON id = doc_id""",
)
def knn_hydrated(spark, folder):
    points = vectors(spark, folder)
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    found = S.knn_hydrated(points, docs, S.query_vector(points, 1))
    return found.withColumn("score", r6("score"))


@query(
    "knn_batch",
    """WITH q AS (SELECT label AS qid, list(m ORDER BY dim) AS qvec FROM (
                    SELECT label, dim, avg(x) AS m FROM (
                      SELECT label, unnest(embedding::DOUBLE[]) AS x,
                             generate_subscripts(embedding, 1) AS dim FROM embeddings)
                    GROUP BY ALL) GROUP BY label),
            s AS (SELECT qid, vec_id AS id,
                         list_cosine_similarity(embedding::DOUBLE[], qvec) AS score
                  FROM q, embeddings)
       SELECT CAST(qid AS BIGINT) AS qid, id, round(score, 6) + 0e0 AS score,
              row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
       FROM s QUALIFY rank <= 10""",
)
def knn_batch(spark, folder):
    points = vectors(spark, folder)
    centres = cluster_profile(points, "label").selectExpr(
        "CAST(label AS BIGINT) AS qid", "vec AS qvec"
    )
    found = S.knn_batch(points, centres, 10)
    return found.select("qid", "id", r6("score").alias("score"), F.col("rank").cast("bigint"))


_NEXT = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_AB = "a.embedding::DOUBLE[], b.embedding::DOUBLE[]"


def _neighbours(spark, folder):
    points = vectors(spark, folder).select("id", "vec")
    return points, points.withColumn("id", F.col("id") - 1)


@query(
    "pairwise_cosine",
    f"SELECT a.vec_id AS id, round(list_cosine_similarity({_AB}), 6) + 0e0 AS score FROM {_NEXT}",
)
def pairwise_cosine(spark, folder):
    return _scores(S.pairwise_similarity(*_neighbours(spark, folder)))


@query(
    "pairwise_l2",
    f"SELECT a.vec_id AS id, round(list_distance({_AB}), 6) + 0e0 AS score FROM {_NEXT}",
)
def pairwise_l2(spark, folder):
    return _scores(S.pairwise_similarity(*_neighbours(spark, folder), metric="l2"))


@query(
    "pairwise_dot_minkowski",
    f"""SELECT a.vec_id AS id, round(list_dot_product({_AB}), 6) + 0e0 AS dot,
               round({_minkowski_sql("a.embedding::DOUBLE[]", "b.embedding::DOUBLE[]", 1.5)}, 6)
               + 0e0 AS minkowski
        FROM {_NEXT}""",
)
def pairwise_dot_minkowski(spark, folder):
    left, right = _neighbours(spark, folder)
    pairs = S.pair_vectors(left, right)
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        "id", r6(V.dot(a, b)).alias("dot"), r6(V.minkowski(a, b, 1.5)).alias("minkowski")
    )


@query(
    "pairwise_histogram",
    f"""WITH v AS (SELECT list_cosine_similarity({_AB}) AS x FROM {_NEXT}),
             r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 100 AS width FROM v),
             c AS (SELECT least(CAST(floor((x - lo) / width) AS INT) + 1, 100) AS bin,
                          count(*) AS n FROM v, r GROUP BY 1)
        SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n
        FROM range(1, 101) t(i) LEFT JOIN c ON c.bin = i""",
)
def pairwise_histogram(spark, folder):
    scores = durable(S.pairwise_similarity(*_neighbours(spark, folder)))  # measured once, read twice
    return histogram(scores, "score", 100).select("bin", "n")


_LETTERS = "aeinorst"


def _embed_letters(df, column, out):
    """Share of common letters in a text: a row-local vector SQL can repeat."""
    low = df.withColumn("_low", F.lower(column))
    size = F.nullif(F.length("_low"), F.lit(0))
    without = [F.length(F.replace("_low", F.lit(x), F.lit(""))) for x in _LETTERS]
    return low.withColumn(out, F.array(*[(size - n) / size for n in without])).drop("_low")


_TYPED = "  Where is the Function that reads a table and joins it?  "
_SHARES = "[{}]".format(
    ", ".join(f"(length(t) - length(replace(t, '{x}', '')))::DOUBLE / length(t)" for x in _LETTERS)
)


@query(
    "text_search",
    f"""WITH q AS (SELECT {_SHARES} AS qv FROM (SELECT lower('{_TYPED}') AS t)),
             e AS (SELECT doc_id AS id, {_SHARES} AS v, source FROM (
                     SELECT doc_id, source, lower(text) AS t FROM documents WHERE text <> '')),
             s AS (SELECT id, source, {_minkowski_sql("v", "qv", 2.5)} AS score FROM e, q),
             t AS (SELECT * FROM s ORDER BY score, id LIMIT 100)
        SELECT t.id, round(score, 6) + 0e0 AS score, source, quality
        FROM t LEFT JOIN labels ON t.id = doc_id""",
)
def text_search(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "id")
    texts = spread(docs.select("id", "text"), "id")
    embedded = _embed_letters(texts, "text", "vec").select("id", "vec")
    labels = table(spark, folder, "labels").selectExpr("doc_id AS id", "quality")
    found = S.text_search(
        embedded,
        _TYPED,
        _embed_letters,
        p=2.5,
        attach=[docs.select("id", "source"), labels],
    )
    return found.withColumn("score", r6("score"))


@query("text_search_hashed")
def text_search_hashed(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "id")
    docs = spread(docs.select("id", "text"), "id")
    model = fit_hashed_tfidf(docs, "text", 1024)

    def embed(df, column, out):
        return hash_embed(model, df, column, out)

    embedded = embed(docs, "text", "vec").select("id", "vec")
    return _scores(S.text_search(embedded, _TYPED, embed, 10, "cosine"))


@query(
    "vector_norms",
    """SELECT vec_id AS id, len(embedding) AS dim,
              round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0e0 AS norm
       FROM embeddings""",
)
def vector_norms(spark, folder):
    return vectors(spark, folder).select(
        "id", F.size("vec").cast("bigint").alias("dim"), r6(V.norm2(F.col("vec"))).alias("norm")
    )
