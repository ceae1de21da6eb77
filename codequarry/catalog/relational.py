"""Filters, slices, joins, set operations, windows, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.catalog import query, table, vectors
from codequarry.operators import joins, rows, sampling
from codequarry.operators.aggregates import dedup_first
from codequarry.operators.clustering import cluster_subset


@query(
    "filter_not_null",
    """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
       WHERE l.quality IS NOT NULL""",
)
def filter_not_null(spark, folder):
    joined = table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return joined.where(F.col("quality").isNotNull()).select("doc_id", "quality")


@query(
    "filter_null",
    """SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)
       WHERE l.quality IS NULL""",
)
def filter_null(spark, folder):
    joined = table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return joined.where(F.col("quality").isNull()).select("doc_id", "lang")


@query("slice_rows", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 20")
def slice_rows(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return rows.slice_rows(part, ["p_partkey"], 20, 30)


@query(
    "head_rows",
    "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 1000",
)
def head_rows(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return rows.head_rows(docs, ["n_chars", "doc_id"], 1000)


@query(
    "sorted_scan",
    """SELECT doc_id, source FROM documents WHERE lang IS NOT NULL AND n_chars > 100
       ORDER BY doc_id""",
)
def sorted_scan(spark, folder):
    docs = table(spark, folder, "documents").where("lang IS NOT NULL AND n_chars > 100")
    return docs.select("doc_id", "source").orderBy("doc_id")


@query(
    "filter_len_band",
    "SELECT doc_id, n_chars FROM documents WHERE length(text) > 110 AND length(text) < 1000",
)
def filter_len_band(spark, folder):
    docs = table(spark, folder, "documents")
    return rows.filter_len(docs, "text", gt=110, lt=1000).select("doc_id", "n_chars")


@query("point_lookup", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id = 7")
def point_lookup(spark, folder):
    docs = table(spark, folder, "documents")
    return rows.lookup(docs, "doc_id", 7).select("doc_id", F.md5("text").alias("digest"))


@query(
    "changed_rows",
    """SELECT d.doc_id, md5(d.text) AS old, md5(b.text) AS new
       FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id
       WHERE d.text IS DISTINCT FROM b.text""",
)
def changed_rows(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("a"))
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("text").alias("b")
    )
    changed = rows.changed_rows(docs.join(items, "doc_id", "left"), "a", "b")
    return changed.select("doc_id", F.md5("a").alias("old"), F.md5("b").alias("new"))


@query(
    "cluster_subset",
    "SELECT vec_id AS id, label FROM embeddings WHERE label >= 5 AND label < 10",
)
def subset_of_clusters(spark, folder):
    return cluster_subset(vectors(spark, folder), 5, 10, "label").select("id", "label")


@query(
    "lookup_left",
    """SELECT s_suppkey, s_nationkey, n_name FROM supplier
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON s_nationkey = n_nationkey""",
)
def lookup_left(spark, folder):
    nations = table(spark, folder, "nation").where("n_regionkey <> 0")
    names = nations.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return joins.lookup_join(suppliers, names, "s_nationkey")


@query(
    "lookup_salted",
    """SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem
       LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def lookup_salted(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    return joins.lookup_join(lines, orders, "l_orderkey")


@query(
    "attach_repo",
    """WITH repos AS (SELECT 'src' || (s_suppkey % 15) AS name, min(s_suppkey) AS idx
                      FROM supplier GROUP BY 1)
       SELECT doc_id AS file, source AS archive, idx AS repo
       FROM documents LEFT JOIN repos ON source = name""",
)
def attach_repo(spark, folder):
    repos = table(spark, folder, "supplier").select(
        F.concat(F.lit("src"), F.col("s_suppkey") % 15).alias("name"),
        F.col("s_suppkey").alias("index"),
    )
    files = table(spark, folder, "documents").select(
        F.col("doc_id").alias("file"), F.col("source").alias("archive")
    )
    return joins.attach_repo(files, repos)


@query(
    "align_full",
    """SELECT coalesce(e.vec_id, l.doc_id) AS id, e.label, l.quality
       FROM embeddings e FULL JOIN labels l ON e.vec_id = l.doc_id""",
)
def align_full(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    return joins.join_coords(vectors(spark, folder).select("id", "label"), labels)


@query(
    "hydrate_left",
    """SELECT vec_id AS id, label, lang, md5(text) AS digest
       FROM embeddings LEFT JOIN documents ON vec_id = doc_id""",
)
def hydrate_left(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "lang", F.md5("text").alias("digest")
    )
    return joins.hydrate(vectors(spark, folder).select("id", "label"), docs)


@query(
    "anti_join",
    """SELECT doc_id, source FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def anti_join(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return joins.not_in(docs, table(spark, folder, "labels"), "doc_id")


@query(
    "semi_join",
    """SELECT doc_id, source FROM documents d
       WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def semi_join(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return joins.restrict_to(docs, table(spark, folder, "labels"), "doc_id")


@query(
    "missing_keys",
    """SELECT count(*) AS missing FROM (
         SELECT DISTINCT doc_id FROM documents
         WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))""",
)
def missing_keys(spark, folder):
    wanted = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    return joins.missing_keys(vectors(spark, folder), wanted, "id")


@query(
    "union_missing",
    """SELECT doc_id AS id, md5(text) AS digest, lang FROM documents
       UNION ALL SELECT item_id, md5(text), NULL FROM benchmark""",
)
def union_missing(spark, folder):
    digest = F.md5("text").alias("digest")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), digest, "lang")
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), digest)
    return rows.union_fill(docs, items)


@query(
    "union_all",
    """SELECT doc_id AS id, n_chars AS size FROM documents
       UNION ALL SELECT page_id, length(html) FROM pages""",
)
def union_all(spark, folder):
    docs = table(spark, folder, "documents").selectExpr("doc_id AS id", "n_chars AS size")
    pages = table(spark, folder, "pages").selectExpr(
        "CAST(length(html) AS BIGINT) AS size", "page_id AS id"
    )
    return docs.unionByName(pages)


@query(
    "dedup_text",
    """SELECT doc_id, lang, source FROM (
         SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
       WHERE rn = 1""",
)
def dedup_text(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return dedup_first(docs, ["text"], ["doc_id"]).drop("text")


@query(
    "dedup_two_keys",
    """SELECT doc_id, md5(text) AS digest, lang FROM (
         SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn
         FROM documents) WHERE rn = 1""",
)
def dedup_two_keys(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return dedup_first(docs, ["text", "lang"], ["doc_id"]).select(
        "doc_id", F.md5("text").alias("digest"), "lang"
    )


@query(
    "dedup_null_keys",
    """SELECT doc_id, quality FROM (
         SELECT d.doc_id, l.quality,
                row_number() OVER (PARTITION BY l.quality ORDER BY d.doc_id) AS rn
         FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE rn = 1""",
)
def dedup_null_keys(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    graded = docs.join(table(spark, folder, "labels"), "doc_id", "left")
    return dedup_first(graded.select("doc_id", "quality"), ["quality"], ["doc_id"])


@query(
    "row_index",
    """SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS row FROM documents""",
)
def row_index(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return rows.with_row_index(docs, ["n_chars", "doc_id"]).select("doc_id", "row")


@query(
    "cumulative_counts",
    """SELECT source, n, CAST(sum(n) OVER (ORDER BY source) AS BIGINT) AS upto
       FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""",
)
def cumulative_counts(spark, folder):
    counts = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return rows.cumulative(counts, ["source"], "n", "upto")


@query(
    "top_n_size",
    """SELECT p_partkey, p_name, p_size FROM part
       ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 30""",
)
def top_n_size(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    return rows.top_n(part, "p_size", 30, "p_partkey")


@query(
    "argmax_row",
    """SELECT source, count(*) AS n FROM documents GROUP BY source
       ORDER BY n DESC, source LIMIT 1""",
)
def argmax_row(spark, folder):
    counts = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return rows.argmax_row(counts, "n", "source")


_UNIT = "(('0x' || substring(md5('42:' || doc_id::VARCHAR), 1, 8))::BIGINT) / 4294967296e0"


@query("sample_frac", f"SELECT doc_id, lang FROM documents WHERE {_UNIT} < 0.1")
def sample_frac(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.sample_frac(docs, 0.1, "doc_id")


@query(
    "sample_n",
    """SELECT doc_id, lang FROM documents
       ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 100""",
)
def sample_n(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.sample_n(docs, 100, "doc_id")


@query(
    "sample_n_repl",
    """WITH numbered AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS r
                         FROM documents),
            draws AS (SELECT i AS draw,
                             (('0x' || substring(md5('42:' || i::VARCHAR), 1, 12))::BIGINT)
                             % (SELECT count(*) FROM documents) AS r
                      FROM range(5000) t(i))
       SELECT draw, doc_id, lang FROM draws JOIN numbered USING (r)""",
)
def sample_n_repl(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.sample_n_repl(docs, 5000, "doc_id")


@query(
    "split_train_test",
    f"""SELECT doc_id, CASE WHEN {_UNIT} < 0.15 THEN 'test' ELSE 'train' END AS part
        FROM documents""",
)
def split_train_test(spark, folder):
    train, test = sampling.split(table(spark, folder, "documents").select("doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


@query(
    "sample_n_hostile",
    "SELECT 57::BIGINT AS n, 57::BIGINT AS ids, true AS drawn",
)
def sample_n_hostile(spark, folder):
    """A key that is NULL for most rows and repeated for the rest: exactly as many as asked."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    drawn = sampling.sample_n(rows.select("doc_id", "quality", "toxic"), 57, "quality")
    return drawn.agg(
        F.count("*").alias("n"),
        F.count_distinct("doc_id").alias("ids"),
        (F.count_distinct(F.coalesce("quality", F.lit(-1))) <= 3).alias("drawn"),
    )


@query(
    "sample_n_repl_hostile",
    "SELECT 90::BIGINT AS n, 90::BIGINT AS draws",
)
def sample_n_repl_hostile(spark, folder):
    """The same key, drawn with replacement: one row for each draw."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    drawn = sampling.sample_n_repl(rows.select("doc_id", "quality"), 90, "quality")
    return drawn.agg(F.count("*").alias("n"), F.count_distinct("draw").alias("draws"))


@query(
    "split_null_keys",
    """SELECT CASE WHEN quality IS NOT NULL AND (('0x' || substring(md5('42:' || quality::VARCHAR), 1, 8))::BIGINT)
                        / 4294967296e0 < 0.15
                   OR quality IS NULL AND (('0x' || substring(md5('42:' || chr(0)), 1, 8))::BIGINT)
                        / 4294967296e0 < 0.15 THEN 'test' ELSE 'train' END AS part,
              count(*) AS n
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def split_null_keys(spark, folder):
    """Rows with a NULL key are in one part too."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    train, test = sampling.split(rows.select("doc_id", "quality"), "quality")
    parts = train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part").agg(F.count("*").alias("n"))
