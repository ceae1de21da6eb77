"""Reduction, clustering, model selection and batch scoring."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.catalog import query, r6, spread, table, vectors
from codequarry.functions.vectors import norm2
from codequarry.operators import clustering as C
from codequarry.operators import reduction as R
from codequarry.operators.moments import Moments, moments
from codequarry.operators.rows import argmax_row
from codequarry.operators.scoring import score_batches
from codequarry.operators.silhouettes import labelled_silhouettes
from codequarry.operators.sketch_svd import fit_svd_sketch
from codequarry.operators.tfidf import fit_hashed_tfidf, hash_embed, tfidf_vectors
from codequarry.session import scratch_path

# Numbers in a vector of the test tables.
WIDTH = 64


@query(
    "covariance",
    """WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v,
                         generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
       SELECT a.d AS i, b.d AS j, round(covar_samp(a.v, b.v), 6) + 0e0 AS cov
       FROM x a JOIN x b USING (vec_id) GROUP BY ALL""",
)
def covariance(spark, folder):
    return R.covariance(vectors(spark, folder)).withColumn("cov", r6("cov"))


def _halves(spark, folder):
    """A state of one half of the vectors, stored, read back and extended by the other."""
    points = vectors(spark, folder)
    path = scratch_path(spark, "moments")
    moments(points.where("id % 2 = 0")).write(spark, path)
    return Moments.read(spark, path).extend(points.where("id % 2 <> 0"))


@query(
    "covariance_merged",
    """WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v,
                         generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
       SELECT a.d AS i, b.d AS j, round(covar_samp(a.v, b.v), 6) + 0e0 AS cov
       FROM x a JOIN x b USING (vec_id) GROUP BY ALL""",
)
def covariance_merged(spark, folder):
    found = _halves(spark, folder).covariance()
    i, j = np.indices(found.shape).reshape(2, -1)
    rows = list(zip(i.tolist(), j.tolist(), found.ravel().tolist()))
    return spark.createDataFrame(rows, "i bigint, j bigint, cov double").withColumn("cov", r6("cov"))


@query(
    "pca_incremental",
    """SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[],
              (SELECT list(m ORDER BY d) FROM (SELECT d, avg(v) AS m FROM (
                 SELECT unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS d
                 FROM embeddings) GROUP BY d))), 6) + 0e0 AS from_centre
       FROM embeddings""",
)
def pca_incremental(spark, folder):
    """The model of a state in two parts, with all components: lengths of scores are distances to the centre."""
    scores = _halves(spark, folder).model(WIDTH).transform(vectors(spark, folder))
    return scores.select("id", r6(norm2(F.col("vec"))).alias("from_centre"))


@query(
    "pca_distances",
    """SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[],
              (SELECT list(m ORDER BY d) FROM (SELECT d, avg(v) AS m FROM (
                 SELECT unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS d
                 FROM embeddings) GROUP BY d))), 6) + 0e0 AS from_centre
       FROM embeddings""",
)
def pca_distances(spark, folder):
    """With all components kept, a score's length is the distance to the centre."""
    points = vectors(spark, folder)
    width = points.select(F.max(F.size("vec"))).first()[0]
    scores = R.fit_pca(points, width).transform(points)
    return scores.select("id", r6(norm2(F.col("vec"))).alias("from_centre"))


@query("pca_scores")
def pca_scores(spark, folder):
    points = vectors(spark, folder)
    scores = R.fit_pca(points, R.PLOT_COMPONENTS).transform(points)
    return scores.select(
        "id", *[r6(F.get("vec", F.lit(i))).alias(n) for i, n in enumerate(("x", "y"))]
    )


@query("pca_variance")
def pca_variance(spark, folder):
    points = vectors(spark, folder)
    return R.variance_table(spark, R.fit_pca(points, 10).ratios)


@query("pca_variance_sampled")
def pca_variance_sampled(spark, folder):
    points = vectors(spark, folder)
    return R.variance_table(spark, R.fit_pca(points, 10, frac=0.1).ratios)


@query(
    "svd_norms",
    """SELECT vec_id AS id,
              round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0e0 AS norm
       FROM embeddings""",
)
def svd_norms(spark, folder):
    """With all components kept, a score is as long as its vector."""
    points = vectors(spark, folder)
    width = points.select(F.max(F.size("vec"))).first()[0]
    rows = points.select("id", R.array_to_vector("vec").alias("features"))
    _, scored = R.fit_svd(rows, width)
    return scored.select("id", r6(norm2(F.col("vec"))).alias("norm"))


# Components kept of the texts' vectors.
TEXT_COMPONENTS = 20
HASHED_COLUMNS = 512


def _hashed_svd(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    features = fit_hashed_tfidf(docs, "text", HASHED_COLUMNS).transform(docs, "text")
    return R.fit_svd(features.select("doc_id", "features"), TEXT_COMPONENTS)


@query("svd_text")
def svd_text(spark, folder):
    _, scored = _hashed_svd(spark, folder)
    return scored.select("doc_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("svd_text_variance")
def svd_text_variance(spark, folder):
    model, _ = _hashed_svd(spark, folder)
    return R.variance_table(spark, model.ratios)


@query("svd_vocabulary", "SELECT true AS uncrossed, true AS squares_agree, true AS falling")
def svd_vocabulary(spark, folder):
    """A column for every term: scores are at right angles, and as long as the singular values."""
    features, _ = tfidf_vectors(table(spark, folder, "documents"), "doc_id", "text")
    model, scored = R.fit_svd(features, TEXT_COMPONENTS, solver="steps")
    x = scored.select(array_to_vector("vec").alias("x"))
    products = RowMatrix(MLUtils.convertVectorColumnsFromML(x, "x")).computeGramianMatrix().toArray()
    squares = model.singular_values**2
    crossed = np.abs(products - np.diag(np.diag(products))).max()
    found = (
        bool(crossed < 1e-6 * squares[0]),
        bool(np.allclose(np.diag(products), squares, rtol=1e-6)),
        bool((np.diff(squares) <= 1e-9).all()),
    )
    return spark.createDataFrame([found], "uncrossed boolean, squares_agree boolean, falling boolean")


@query(
    "hash_embed",
    r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[\p{L}\p{N}_]{2,}')
                            THEN 1e0 ELSE 0e0 END AS norm FROM documents""",
)
def hashed_vectors(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    embedded = hash_embed(fit_hashed_tfidf(docs, "text", 1024), docs)
    return embedded.select("doc_id", r6(norm2(F.col("vec"))).alias("norm"))


@query("kmeans_labels")
def kmeans_labels(spark, folder):
    return C.kmeans(vectors(spark, folder), 10, n_init=3).labels


@query(
    "kmeans_consistency",
    "SELECT count(*) AS points, 0::BIGINT AS misplaced, true AS cost_agrees FROM embeddings",
)
def kmeans_consistency(spark, folder):
    """Every label is the nearest centre, and the distances add up to the cost.

    The reported cost is from before the centres' last move, which is small.
    """
    points = vectors(spark, folder)
    fit = C.kmeans(points, 10, n_init=3)
    nearest = C.assign(points, fit.centres).withColumnRenamed("cluster", "nearest")
    both = fit.labels.join(nearest, "id")
    squares = F.sum(F.col("distance") * F.col("distance"))
    return both.agg(
        F.count("*").alias("points"),
        F.count_if(F.col("cluster") != F.col("nearest")).alias("misplaced"),
        (F.abs(squares - fit.cost) < 1e-3 * fit.cost).alias("cost_agrees"),
    )


_CENTRES = """c AS (SELECT label, list(m ORDER BY d) AS centre FROM (
        SELECT label, d, avg(v) AS m FROM (
          SELECT label, unnest(embedding::DOUBLE[]) AS v,
                 generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY ALL)
      GROUP BY label)"""


@query(
    "assign_nearest",
    f"""WITH {_CENTRES},
        s AS (SELECT vec_id AS id, c.label AS cluster,
                     list_distance(embedding::DOUBLE[], centre) AS distance FROM embeddings, c)
        SELECT id, cluster, round(distance, 6) + 0e0 AS distance FROM s
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1""",
)
def assign_nearest(spark, folder):
    points = vectors(spark, folder)
    centres = C.cluster_profile(points, "label").selectExpr("label AS cluster", "vec")
    return C.assign(points, centres).withColumn("distance", r6("distance"))


_SILHOUETTE = """WITH s AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
     d AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS total,
                  count(*) AS n FROM s a, s b GROUP BY ALL),
     ab AS (SELECT id, own, max(n) FILTER (WHERE own = other) AS size,
                   max(total) FILTER (WHERE own = other) AS within,
                   min(total / n) FILTER (WHERE own <> other) AS b FROM d GROUP BY ALL),
     sc AS (SELECT id, own, CASE WHEN size = 1 THEN 0
                  ELSE (b - within / (size - 1)) / greatest(b, within / (size - 1)) END AS score
            FROM ab)
"""


@query(
    "silhouette_exact", _SILHOUETTE + "SELECT round(avg(score), 6) + 0e0 AS silhouette FROM sc"
)
def silhouette_exact(spark, folder):
    points = vectors(spark, folder).withColumnRenamed("label", "cluster")
    return C.silhouette(points).withColumn("silhouette", r6("silhouette"))


# The moments of a spectrum: a basis that is not the right one has others.
_COVARIANCE = """x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v,
                  generate_subscripts(embedding, 1) AS d FROM embeddings),
     c AS (SELECT a.d AS i, b.d AS j, covar_samp(a.v, b.v) AS cov
           FROM x a JOIN x b USING (vec_id) GROUP BY ALL)"""


@query(
    "pca_spectrum",
    f"""WITH {_COVARIANCE}, t AS (SELECT sum(cov) FILTER (WHERE i = j) AS trace FROM c)
        SELECT 1e0 AS total, round(sum(cov * cov) / any_value(trace * trace), 6) + 0e0 AS squares,
               true AS falling FROM c, t""",
)
def pca_spectrum(spark, folder):
    """Shares of variance: they fall, add up to one, and their squares to the covariance's."""
    points = vectors(spark, folder)
    ratios = R.fit_pca(points, WIDTH).ratios
    table = R.variance_table(spark, ratios)
    before = F.lag("ratio").over(Window.orderBy("component"))
    return table.withColumn("before", before).agg(
        r6(F.sum("ratio")).alias("total"),
        r6(F.sum(F.col("ratio") * F.col("ratio"))).alias("squares"),
        F.coalesce(F.min(F.col("before") >= F.col("ratio") - 1e-12), F.lit(True)).alias("falling"),
    )


@query(
    "pca_score_covariance",
    f"""WITH {_COVARIANCE}
        SELECT round(sum(cov) FILTER (WHERE i = j), 6) + 0e0 AS trace,
               round(sum(cov * cov), 6) + 0e0 AS squares, 0e0 AS off_diagonal FROM c""",
)
def pca_score_covariance(spark, folder):
    """Scores are uncorrelated and have the whole variance: no other rotation does."""
    points = vectors(spark, folder)
    cov = R.covariance(R.fit_pca(points, WIDTH).transform(points))
    diagonal = F.col("i") == F.col("j")
    return cov.agg(
        r6(F.sum(F.when(diagonal, F.col("cov")))).alias("trace"),
        r6(F.sum(F.when(diagonal, F.col("cov") * F.col("cov")))).alias("squares"),
        r6(F.max(F.when(~diagonal, F.abs("cov")))).alias("off_diagonal"),
    )


@query(
    "svd_spectrum",
    """WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v,
                         generate_subscripts(embedding, 1) AS d FROM embeddings),
            g AS (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) AS p FROM x a JOIN x b USING (vec_id) GROUP BY ALL)
       SELECT round(sum(p) FILTER (WHERE i = j), 4) + 0e0 AS squares,
              round(sum(p * p) / 1000, 4) + 0e0 AS fourths FROM g""",
)
def svd_spectrum(spark, folder):
    """Singular values: their squares and fourth powers add up to those of the rows' products."""
    rows = vectors(spark, folder).select("id", R.array_to_vector("vec").alias("features"))
    model, _ = R.fit_svd(rows, WIDTH)
    found = spark.createDataFrame([(float(s),) for s in model.singular_values], "s double")
    return found.agg(
        (F.round(F.sum(F.pow("s", F.lit(2))), 4) + F.lit(0.0)).alias("squares"),
        (F.round(F.sum(F.pow("s", F.lit(4))) / 1000, 4) + F.lit(0.0)).alias("fourths"),
    )


@query(
    "svd_sketch_spectrum",
    """WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v,
                         generate_subscripts(embedding, 1) AS d FROM embeddings),
            g AS (SELECT a.d AS i, b.d AS j, sum(a.v * b.v) AS p FROM x a JOIN x b USING (vec_id) GROUP BY ALL)
       SELECT round(sum(p) FILTER (WHERE i = j), 4) + 0e0 AS squares,
              round(sum(p * p) / 1000, 4) + 0e0 AS fourths FROM g""",
)
def svd_sketch_spectrum(spark, folder):
    """The same from the sketch, which is exact where it is as wide as the vectors."""
    rows = vectors(spark, folder).select("id", R.array_to_vector("vec").alias("features"))
    model, _ = fit_svd_sketch(rows, WIDTH)
    found = spark.createDataFrame([(float(s),) for s in model.singular_values], "s double")
    return found.agg(
        (F.round(F.sum(F.pow("s", F.lit(2))), 4) + F.lit(0.0)).alias("squares"),
        (F.round(F.sum(F.pow("s", F.lit(4))) / 1000, 4) + F.lit(0.0)).alias("fourths"),
    )


@query(
    "silhouette_samples",
    _SILHOUETTE
    + "SELECT id, own::BIGINT AS cluster, round(score, 6) + 0e0 AS silhouette FROM sc",
)
def silhouette_samples(spark, folder):
    """Vectors cut short have no score and end no job."""
    points = vectors(spark, folder).withColumnRenamed("label", "cluster")
    short = points.where("id % 50 = 7").select(-F.col("id"), F.slice("vec", 1, 5), "cluster")
    scores = C.silhouette_samples(points.union(short))
    return scores.withColumn("silhouette", r6("silhouette"))


@query(
    "silhouette_ways",
    "WITH ways AS ("
    + " UNION ALL ".join(
        f"""SELECT {way} AS way, avg(score) AS score FROM (
        WITH s AS (SELECT vec_id AS id, {cluster} AS label, embedding::DOUBLE[] AS v FROM embeddings),"""
        + _SILHOUETTE.split("\n", 1)[1]
        + " SELECT score FROM sc)"
        for way, cluster in enumerate(("label", "label % 4", "CASE WHEN vec_id = 0 THEN 1 ELSE label // 7 END"))
    )
    + ") SELECT way::BIGINT AS way, round(score, 6) + 0e0 AS score FROM ways",
)
def silhouette_ways(spark, folder):
    """Three labellings at once, as a sweep scores them; ids repeat and are NULL."""
    points = vectors(spark, folder)
    ways = F.array("label", F.col("label") % 4, F.when(F.col("id") == 0, 1).otherwise(F.expr("label div 7")))
    odd = F.when(F.col("id") % 3 > 0, F.col("id") % 5)
    scores = labelled_silhouettes(points.select(odd.alias("id"), "vec", ways.cast("array<bigint>").alias("labels")), "id")
    each = scores.select(F.posexplode("scores").alias("way", "score"))
    return each.groupBy(F.col("way").cast("bigint").alias("way")).agg(r6(F.avg("score")).alias("score"))


@query(
    "silhouette_squared",
    _SILHOUETTE.replace("sum(list_distance(a.v, b.v))", "sum(list_distance(a.v, b.v) ** 2)")
    + "SELECT round(avg(score), 6) + 0e0 AS silhouette FROM sc",
)
def silhouette_squared(spark, folder):
    points = vectors(spark, folder).withColumnRenamed("label", "cluster")
    return spark.createDataFrame([(round(C.silhouette_squared(points), 6),)], "silhouette double")


@query("sweep")
def sweep(spark, folder):
    return C.sweep(vectors(spark, folder), ks=(5, 10, 15), n_init=2)


@query("best_clustering")
def best_clustering(spark, folder):
    _, fit, _ = C.best_clustering(vectors(spark, folder), ks=(8, 12), n_init=2)
    return C.cluster_profile(fit.labelled).select("cluster", "n")


@query(
    "best_score",
    """SELECT label, round(avg(embedding[1]::DOUBLE), 6) + 0e0 AS score FROM embeddings
       GROUP BY label ORDER BY avg(embedding[1]::DOUBLE) DESC, label LIMIT 1""",
)
def best_score(spark, folder):
    scores = vectors(spark, folder).groupBy("label").agg(
        F.avg(F.get("vec", F.lit(0)).cast("double")).alias("score")
    )
    return argmax_row(scores, "score", "label").withColumn("score", r6("score"))


def _linear_model():
    def score(batch):
        rows = np.stack(batch.to_numpy()).astype(np.float64)
        return rows @ (np.arange(1, rows.shape[1] + 1) / rows.shape[1])

    return score


@query(
    "score_linear",
    """SELECT vec_id AS id, label, round(list_dot_product(embedding::DOUBLE[],
              list_transform(range(1, len(embedding) + 1), lambda i: i::DOUBLE / len(embedding))),
              6) + 0e0 AS score FROM embeddings""",
)
def score_linear(spark, folder):
    scored = score_batches(
        vectors(spark, folder), _linear_model, "vec", "score double", 64, ("id", "label")
    )
    return scored.withColumn("score", r6("score"))
