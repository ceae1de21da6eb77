"""Counts, tags, histograms, rasters, extents, centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.catalog import query, r6, spread, table, vectors
from codequarry.operators import aggregates as A
from codequarry.operators.clustering import cluster_profile
from codequarry.plans import maps


@query(
    "explode_words",
    """SELECT source, word, count(*) AS n FROM (
         SELECT source, unnest(string_split(text, ' ')) AS word FROM documents)
       WHERE word <> '' GROUP BY source, word""",
)
def explode_words(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id")
    words = F.filter(F.split("text", " "), lambda word: word != "")
    return (
        docs.select("source", F.explode(words).alias("word"))
        .groupBy("source", "word")
        .agg(F.count("*").alias("n"))
    )


@query(
    "count_by_source",
    """SELECT source, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id)
       WHERE source IS NOT NULL GROUP BY source""",
)
def count_by_source(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return A.count_by(docs.join(labels, "doc_id", "left"), "source", "quality")


@query(
    "count_by_number",
    """SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, count(o_orderkey) AS n FROM orders
       GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 30""",
)
def count_by_number(spark, folder):
    from codequarry.operators.rows import top_n

    counts = A.count_by(table(spark, folder, "orders"), "o_custkey", "o_orderkey")
    return top_n(counts, "n", 30, "o_custkey")


@query(
    "corpus_stats",
    """SELECT count(DISTINCT source) AS groups,
              round(sum(strlen(text)) / 1048576.0, 6) + 0e0 AS mebibytes,
              CAST(sum((length(text) - length(replace(text, 'the ', ''))) // 4) AS BIGINT) AS hits
       FROM documents""",
)
def corpus_stats(spark, folder):
    stats = A.corpus_stats(table(spark, folder, "documents"), "source", "text", "the ")
    return stats.withColumn("mebibytes", r6("mebibytes"))


# Part names stand in for topic lists: 'small-ring' and 'small', 'ring'.
_TOPIC_SQL = """WITH tags AS (
    SELECT p_size, unnest(list_append(string_split(p_name, ' '), replace(p_name, ' ', '-'))) AS raw
    FROM part)
"""


def _topics(spark, folder):
    names = F.split("p_name", " ")
    tags = F.array_append(names, F.translate("p_name", " ", "-"))
    quoted = F.transform(tags, lambda tag: F.concat(F.lit("' "), tag, F.lit("'")))
    literal = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return table(spark, folder, "part").select(
        literal.alias("topics"), F.col("p_size").alias("size")
    )


@query(
    "tag_counts",
    _TOPIC_SQL
    + "SELECT replace(raw, '-', chr(10)) AS tag, count(*) AS n FROM tags GROUP BY 1 HAVING n > 2",
)
def tag_counts(spark, folder):
    return A.tag_counts(_topics(spark, folder))


@query(
    "tag_weights",
    _TOPIC_SQL
    + """SELECT replace(raw, '-', chr(10)) AS tag, CAST(sum(p_size) AS BIGINT) AS weight
         FROM tags GROUP BY 1 ORDER BY weight DESC, tag LIMIT 50""",
)
def tag_weights(spark, folder):
    return A.tag_weights(_topics(spark, folder))


@query(
    "unparsed_topics",
    "SELECT count(*) FILTER (WHERE lang = 'fr') AS unparsed FROM documents",
)
def unparsed_topics(spark, folder):
    literal = F.when(F.col("lang") == "fr", "['don't']").otherwise(
        F.concat(F.lit("['"), "lang", F.lit("']"))
    )
    return A.unparsed_topics(table(spark, folder, "documents").select(literal.alias("topics")))


@query(
    "list_fill_stats",
    r"""SELECT count(*) FILTER (WHERE len(words) > 0) AS filled,
               count(*) FILTER (WHERE len(words) = 0) AS empty
        FROM (SELECT regexp_extract_all(text, '[A-Za-z]{12,}') AS words FROM documents)""",
)
def list_fill_stats(spark, folder):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{12,}"), F.lit(0))
    return A.list_fill_stats(table(spark, folder, "documents").select(words.alias("w")), "w")


def _histogram_sql(bins: int, group: str, value: str, source: str, shown: str) -> str:
    return f"""WITH v AS (SELECT {group} AS g, ({value})::DOUBLE AS x FROM {source}
                          WHERE ({value}) IS NOT NULL),
        r AS (SELECT g, min(x) AS lo, max(x) AS hi, count(*) AS total FROM v GROUP BY g),
        c AS (SELECT g, least(CAST(floor((x - lo) / ((hi - lo) / {bins})) AS INT) + 1, {bins}) AS bin,
                     count(*) AS n FROM v JOIN r USING (g) GROUP BY ALL),
        b AS (SELECT g, lo, (hi - lo) / {bins} AS width, total, CAST(i AS INT) AS bin
              FROM r, range(1, {bins} + 1) t(i))
        SELECT {shown} FROM b LEFT JOIN c USING (g, bin)"""


_EDGES_SQL = "round(lo + (bin - 1) * width, 6) + 0e0 AS lo, round(lo + bin * width, 6) + 0e0 AS hi"
_DENSITY_SQL = "round(coalesce(n, 0) / (total * width), 6) + 0e0 AS density"


@query(
    "hist_nchars",
    _histogram_sql(
        30, "0", "n_chars", "documents", f"bin, {_EDGES_SQL}, coalesce(n, 0) AS n"
    ),
)
def hist_nchars(spark, folder):
    found = A.histogram(table(spark, folder, "documents"), "n_chars", 30)
    return found.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@query(
    "hist_short_texts",
    _histogram_sql(
        100,
        "0",
        "CASE WHEN length(text) < 4000 THEN length(text) END",
        "documents",
        f"bin, {_EDGES_SQL}, {_DENSITY_SQL}",
    ),
)
def hist_short_texts(spark, folder):
    from codequarry.operators.rows import filter_len

    brief = filter_len(table(spark, folder, "documents"), "text", lt=4000)
    sized = brief.select(F.length("text").alias("size"))
    found = A.histogram(sized, "size", 100, density=True)
    return found.select(
        "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), r6("density").alias("density")
    )


@query(
    "hist_density_by_lang",
    _histogram_sql(
        100, "lang", "n_chars", "documents", f"g AS lang, bin, {_EDGES_SQL}, {_DENSITY_SQL}"
    ),
)
def hist_density_by_lang(spark, folder):
    found = A.histogram_by(
        table(spark, folder, "documents"), "lang", "n_chars", 100, density=True
    )
    return found.select(
        "lang", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), r6("density").alias("density")
    )


def _plane(spark, folder):
    points = vectors(spark, folder)
    axis = {name: F.get("vec", F.lit(i)).cast("double") for i, name in enumerate("xyz")}
    return points.select(
        "id", *[c.alias(n) for n, c in axis.items()], F.col("label").alias("cluster")
    )


@query(
    "raster_2d",
    """WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings),
            r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
       SELECT least(CAST(floor((x - x0) / (x1 - x0) * 800) AS INT), 799) AS px,
              least(CAST(floor((y - y0) / (y1 - y0) * 600) AS INT), 599) AS py,
              label AS cluster, count(*) AS n
       FROM p, r GROUP BY ALL""",
)
def raster_2d(spark, folder):
    return maps.map_raster(_plane(spark, folder))


@query(
    "extents",
    """SELECT min(embedding[1]::DOUBLE) AS x_min, max(embedding[1]::DOUBLE) AS x_max,
              min(embedding[2]::DOUBLE) AS y_min, max(embedding[2]::DOUBLE) AS y_max,
              min(embedding[3]::DOUBLE) AS z_min, max(embedding[3]::DOUBLE) AS z_max
       FROM embeddings""",
)
def extents(spark, folder):
    return maps.map_box(_plane(spark, folder))


@query(
    "map_points",
    """SELECT coalesce(e.vec_id, l.doc_id) AS id, embedding[1]::DOUBLE AS x,
              embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, l.quality AS cluster,
              d.source AS name, md5(d.text) AS body
       FROM embeddings e FULL JOIN labels l ON e.vec_id = l.doc_id
       LEFT JOIN documents d ON d.doc_id = coalesce(e.vec_id, l.doc_id)""",
)
def map_points(spark, folder):
    clusters = table(spark, folder, "labels").selectExpr("doc_id AS id", "quality AS cluster")
    functions = table(spark, folder, "documents").selectExpr(
        "doc_id AS id", "source AS name", "text AS body"
    )
    coords = _plane(spark, folder).drop("cluster")
    return maps.map_points(coords, clusters, functions).withColumn("body", F.md5("body"))


@query(
    "longest_text",
    """SELECT doc_id, length(text) AS length, md5(text) AS digest FROM documents
       ORDER BY length DESC, doc_id LIMIT 1""",
)
def longest_text(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return A.longest(docs, "text", "doc_id").select(
        "doc_id", F.col("length").cast("bigint").alias("length"), F.md5("text").alias("digest")
    )


@query(
    "centroids",
    """SELECT label, dim, count(*) AS n, round(avg(x), 6) + 0e0 AS value FROM (
         SELECT label, unnest(embedding::DOUBLE[]) AS x,
                CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim FROM embeddings)
       GROUP BY label, dim""",
)
def centroids(spark, folder):
    profile = cluster_profile(vectors(spark, folder), "label")
    return profile.select("label", "n", F.posexplode("vec").alias("dim", "value")).withColumn(
        "value", r6("value")
    )


@query(
    "tag_counts_quoted",
    """SELECT tag, count(*) AS n FROM (
         SELECT unnest(['don''t ' || p_brand, p_type, 'say "x"']) AS tag FROM part)
       GROUP BY tag HAVING count(*) > 2""",
)
def tag_counts_quoted(spark, folder):
    """Lists as Python prints them: double quotes around an item with an apostrophe."""
    escaped = F.lit(r"""'say \"x\"'""")
    text = F.concat(
        F.lit("[\"don't "), "p_brand", F.lit("\", '"), "p_type", F.lit("', "), escaped, F.lit("]")
    )
    topics = table(spark, folder, "part").select(text.alias("topics"))
    return A.tag_counts(topics).withColumn("tag", F.replace("tag", F.lit("\n"), F.lit("-")))


@query(
    "hist_with_nan",
    """WITH v AS (SELECT quality::DOUBLE + n_chars AS x FROM documents JOIN labels USING (doc_id)
                  WHERE toxic = 0),
            r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 7 AS width FROM v)
       SELECT CAST(i AS INT) AS bin, count(x) AS n FROM r CROSS JOIN range(1, 8) t(i)
       LEFT JOIN v ON least(CAST(floor((x - lo) / width) AS INT) + 1, 7) = i GROUP BY i""",
)
def hist_with_nan(spark, folder):
    """Values that are no number are in no bin and move no edge."""
    both = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    number = F.when(F.col("toxic") == 0, F.col("quality").cast("double") + F.col("n_chars"))
    values = both.select(F.coalesce(number, F.lit(float("nan"))).alias("x"))
    return A.histogram(values, "x", 7).select("bin", "n")
