"""Curation, training pairs and the quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.catalog import query, r6, table, vectors
from codequarry.plans import curation


def _functions(spark, folder):
    """Documents as functions; German ones have no docstring."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc_"), "doc_id").alias("name"),
        F.array("lang", "source").alias("args"),
        F.col("text").alias("body"),
        F.when(F.col("lang") != "de", F.col("text")).alias("docstring"),
    )


def _judged(spark, folder):
    """The next document stands in for the summary of each."""
    functions = _functions(spark, folder).where("docstring IS NOT NULL")
    summaries = table(spark, folder, "documents").select(
        (F.col("doc_id") - 1).alias("id"), F.col("text").alias("short_docstring")
    )
    points = vectors(spark, folder).select("id", "vec")
    return curation.judge_summaries(
        functions.join(summaries, "id"),
        points,
        points.withColumn("id", F.col("id") - 1),
        threshold=1.4,
    )


_JUDGED = """WITH f AS (SELECT doc_id AS id, lang, source, n_chars,
                   text AS body,
                   CASE WHEN lang <> 'de' THEN text END AS docstring FROM documents),
     s AS (SELECT f.*, d.text AS short_docstring,
                  list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
           FROM f JOIN documents d ON d.doc_id = f.id + 1
           LEFT JOIN (embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) ON a.vec_id = f.id
           WHERE docstring IS NOT NULL),
     j AS (SELECT *, CASE WHEN length(docstring) < 85 THEN docstring
                WHEN distance > 1.4 AND length(docstring) < 120 THEN docstring
                WHEN distance < 1.4 AND length(short_docstring) > length(docstring) THEN NULL
                ELSE short_docstring END AS filtered FROM s),
     k AS (SELECT * FROM j WHERE filtered IS NOT NULL),
     c AS (SELECT id, lang, source, body, docstring, short_docstring, filtered FROM k
           UNION ALL
           SELECT id, lang, source, body, docstring, NULL, NULL FROM f
           WHERE docstring IS NOT NULL AND length(docstring) < 120
             AND NOT EXISTS (SELECT 1 FROM k WHERE k.id = f.id))
"""


@query(
    "curate_rule",
    _JUDGED
    + "SELECT id, round(distance, 6) + 0e0 AS distance, md5(filtered) AS digest FROM j",
)
def curate_rule(spark, folder):
    return _judged(spark, folder).select(
        "id", r6("distance").alias("distance"), F.md5("filtered_docstring").alias("digest")
    )


@query(
    "curate_dataset",
    _JUDGED
    + """SELECT id, md5(docstring) AS doc, md5(short_docstring) AS short, md5(filtered) AS filtered
         FROM c""",
)
def curate_dataset(spark, folder):
    curated = curation.curate(_functions(spark, folder), _judged(spark, folder))
    return curated.select(
        "id",
        F.md5("docstring").alias("doc"),
        F.md5("short_docstring").alias("short"),
        F.md5("filtered_docstring").alias("filtered"),
    )


@query(
    "curate_counts",
    _JUDGED
    + """SELECT count(filtered) AS kept, count(*) AS judged,
                count(*) FILTER (WHERE filtered <> docstring) AS changed FROM j""",
)
def curate_counts(spark, folder):
    kept = F.col("filtered_docstring").isNotNull()
    changed = kept & ~F.col("filtered_docstring").eqNullSafe(F.col("docstring"))
    return _judged(spark, folder).agg(
        F.count("filtered_docstring").alias("kept"),
        F.count("*").alias("judged"),
        F.count_if(changed).alias("changed"),
    )


@query(
    "training_pairs",
    _JUDGED
    + """, y AS (SELECT *, coalesce(filtered, docstring) AS y FROM c),
         u AS (SELECT * FROM y WHERE y IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY y ORDER BY id) = 1)
         SELECT id, md5('def doc_' || id || '(' || lang || ', ' || source || '):' || chr(10)
                        || ' ' || translate(body, chr(10) || chr(13), '  ')) AS x, md5(y) AS y,
                CASE WHEN (('0x' || substring(md5('42:' || id::VARCHAR), 1, 8))::BIGINT)
                          / 4294967296e0 < 0.15 THEN 'test' ELSE 'train' END AS part FROM u""",
)
def training_pairs(spark, folder):
    curated = curation.curate(_functions(spark, folder), _judged(spark, folder))
    pairs = curation.training_pairs(curated)
    return pairs.select("id", F.md5("x").alias("x"), F.md5("y").alias("y"), "part")


@query(
    "summary_requests",
    """SELECT doc_id AS id, md5('Docstring: ' || text || '. Function body: '
              || left(text, 100) || '; Summary: ') AS prompt FROM documents WHERE lang <> 'de'""",
)
def summary_requests(spark, folder):
    requests = curation.summary_requests(_functions(spark, folder))
    return requests.select("id", F.md5("prompt").alias("prompt"))


@query(
    "embedding_requests",
    """SELECT doc_id AS id, 'def doc_' || doc_id || '(' || lang || ', ' || source || '):' || chr(10)
              || ' ' || translate(text, chr(10) || chr(13), '  ') AS text FROM documents""",
)
def embedding_requests(spark, folder):
    return curation.embedding_requests(_functions(spark, folder))


@query(
    "quality_report",
    """WITH v AS (
         SELECT 'one on' AS label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x
         FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
         UNION ALL
         SELECT 'two on', list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
         FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 2
         UNION ALL
         SELECT 'three on', list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
         FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 3),
       r AS (SELECT label, min(x) AS lo, (max(x) - min(x)) / 100 AS width, count(*) AS total
             FROM v GROUP BY label),
       c AS (SELECT label, least(CAST(floor((x - lo) / width) AS INT) + 1, 100) AS bin,
                    count(*) AS n FROM v JOIN r USING (label) GROUP BY ALL)
       SELECT r.label, CAST(i AS INT) AS bin, round(coalesce(n, 0) / (total * width), 6) + 0e0 AS density
       FROM r CROSS JOIN range(1, 101) t(i) LEFT JOIN c ON c.label = r.label AND c.bin = i""",
)
def quality_report(spark, folder):
    points = vectors(spark, folder).select("id", "vec")
    steps = {"one on": 1, "two on": 2, "three on": 3}
    summaries = {
        label: points.withColumn("id", F.col("id") - step) for label, step in steps.items()
    }
    report = curation.quality_report(points, summaries)
    return report.select("label", "bin", r6("density").alias("density"))
