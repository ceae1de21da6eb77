"""Scalar text functions, TF-IDF, functions found in source text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequarry.catalog import query, r6, spread, table
from codequarry.functions import text as T
from codequarry.functions.source_code import BodySplit
from codequarry.operators import tfidf as M
from codequarry.operators.impacts import build_impacts
from codequarry.plans import corpus
from codequarry.session import scratch_path


@query(
    "url_two_parts",
    """SELECT page_id,
              array_to_string(list_slice(string_split(url, '/'), 1, 2), '/') AS slug,
              array_to_string(list_slice(string_split(
                  CASE WHEN starts_with(url, 'https://') THEN substring(url, 9) ELSE url END,
                  '/'), 1, 2), '/') AS under_https
       FROM pages""",
)
def url_two_parts(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        T.repo_slug(F.col("url")).alias("slug"),
        T.repo_slug(F.col("url"), "https://").alias("under_https"),
    )


@query(
    "repo_slug",
    """SELECT page_id, 'o' || page_id || '/' || string_split(url, '/')[4] AS slug FROM pages""",
)
def repo_slug(spark, folder):
    link = F.concat(
        F.lit("https://github.com/o"), "page_id", F.lit("/"),
        F.split_part("url", F.lit("/"), F.lit(4)), F.lit("/tree/main"),
    )
    return table(spark, folder, "pages").select("page_id", T.repo_slug(link).alias("slug"))


_TAG = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""


@query(
    "first_link",
    rf"""WITH clean AS (
           SELECT page_id, regexp_replace(html,
               '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS h
           FROM pages),
         hrefs AS (
           SELECT page_id, list_transform(regexp_extract_all(h, '{_TAG}'),
               lambda t: replace(regexp_extract(t, '{_TAG}', 1) || regexp_extract(t, '{_TAG}', 2)
                                 || regexp_extract(t, '{_TAG}', 3), '&amp;', '&')) AS l
           FROM clean)
         SELECT page_id, list_filter(l, lambda x: contains(x, '/'))[1] AS any_link,
                list_filter(l, lambda x: contains(x, '/t'))[1] AS t_link FROM hrefs""",
)
def first_link(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        T.first_link(F.col("html"), "/").alias("any_link"),
        T.first_link(F.col("html"), "/t").alias("t_link"),
    )


@query(
    "prefer_first",
    """SELECT p_partkey, coalesce(
           list_filter(w, lambda x: x IN ('red', 'small', 'ring'))[1],
           list_filter(w, lambda x: x = w[-1])[1]) AS word
       FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
)
def prefer_first(spark, folder):
    words = F.split("p_name", " ")
    picked = T.prefer_first(words, ("red", "small", "ring"), F.element_at(words, -1))
    return table(spark, folder, "part").select("p_partkey", picked.alias("word"))


@query(
    "preferred_branch",
    """SELECT s_suppkey,
              CASE WHEN s_suppkey % 3 = 0 THEN 'main' WHEN s_nationkey < 12 THEN n_name END AS branch_name,
              CASE WHEN s_suppkey % 3 = 0 THEN 'https://host/r/' || s_suppkey || '/zipball'
                   WHEN s_nationkey < 12 THEN 'https://host/n/' || s_suppkey || '/zipball' END AS url
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def preferred_branch(spark, folder):
    named = table(spark, folder, "supplier").join(
        table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )

    def branch(name, kind):
        link = F.concat(F.lit(f"https://host/{kind}/"), "s_suppkey", F.lit("/commits/ab1"))
        return F.struct(name.alias("name"), F.struct(link.alias("url")).alias("commit"))

    listed = F.array(branch(F.col("n_name"), "n"), branch(F.lit("main"), "r"))
    other = F.array(branch(F.lit("dev"), "d"), branch(F.col("n_name"), "n"))
    repos = named.select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 3 == 0, listed).otherwise(other).alias("branches"),
        F.when(F.col("s_nationkey") < 12, F.col("n_name")).otherwise("gone").alias(
            "default_branch"
        ),
    )
    url = T.archive_url(F.col("branch_url")).alias("url")
    return corpus.with_branch(repos).select("s_suppkey", "branch_name", url)


@query(
    "format_args",
    """SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '),
              lambda x: x <> ''), ', ') AS args FROM part""",
)
def format_args(spark, folder):
    braced = F.concat(F.lit("{ "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit("}"))
    return table(spark, folder, "part").select("p_partkey", T.format_args(braced).alias("args"))


@query(
    "flatten_text",
    r"""SELECT doc_id, md5(regexp_replace(text, '[\n\r]', ' ', 'g')) AS digest FROM documents""",
)
def flatten_text(spark, folder):
    flat = T.flatten(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(flat).alias("digest"))


_RENDERED = r"""'def doc_' || doc_id || '(' || lang || ', ' || source || '):' || chr(10) || ' '
    || regexp_replace(text, '[\n\r]', ' ', 'g')"""


@query(
    "render_text",
    f"""SELECT doc_id, md5({_RENDERED}) AS plain,
               md5({_RENDERED} || chr(10) || chr(10) ||
                   CASE WHEN lang = 'en' THEN source ELSE '' END) AS documented
        FROM documents""",
)
def render_text(spark, folder):
    name = F.concat(F.lit("doc_"), F.col("doc_id"))
    args = T.format_args(F.concat(F.lit("{"), "lang", F.lit(" "), "source", F.lit("}")))
    docstring = F.when(F.col("lang") == "en", F.col("source"))
    return table(spark, folder, "documents").select(
        "doc_id",
        F.md5(T.render_function(name, args, F.col("text"))).alias("plain"),
        F.md5(T.render_with_docstring(name, args, F.col("text"), docstring)).alias("documented"),
    )


@query(
    "cap_text",
    """SELECT doc_id, md5(substring(text, 1, 4096)) AS digest,
              least(length(text), 8192) AS size FROM documents""",
)
def cap_text(spark, folder):
    wide = F.length(T.cap(F.col("text"), 8192)).cast("bigint")
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(T.cap(F.col("text"))).alias("digest"), wide.alias("size")
    )


@query(
    "prompt_text",
    """SELECT doc_id, md5('Docstring: ' || source || '. Function body: ' ||
                          substring(text, 1, 100) || '; Summary: ') AS digest FROM documents""",
)
def prompt_text(spark, folder):
    prompt = T.summary_prompt(F.col("source"), F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(prompt).alias("digest"))


@query(
    "coalesce_text",
    """SELECT d.doc_id, md5(coalesce(b.text, d.text)) AS digest
       FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id""",
)
def coalesce_text(spark, folder):
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("text").alias("short")
    )
    joined = table(spark, folder, "documents").join(items, "doc_id", "left")
    return joined.select("doc_id", F.md5(F.coalesce("short", "text")).alias("digest"))


@query(
    "search_text",
    """SELECT conv_id, turn, CASE WHEN trim(translate(text, chr(9) || chr(10) || chr(13), '   ')) <> ''
              THEN md5(substring(lower(text), 1, 4096)) END AS digest FROM conversations""",
)
def search_text(spark, folder):
    digest = F.md5(T.search_text(F.col("text"))).alias("digest")
    return table(spark, folder, "conversations").select("conv_id", "turn", digest)


@query(
    "strip_nul",
    "SELECT doc_id, md5(text) AS digest, length(text) AS size FROM documents",
)
def strip_nul(spark, folder):
    marked = F.concat(F.lit("\0"), F.replace("text", F.lit("e"), F.lit("e\0")))
    clean = T.strip_nul(marked)
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("size")
    )


@query(
    "path_parts",
    r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || '.tar' AS stem,
               string_split(url, '/')[-1] <> '' AS is_source FROM pages""",
)
def path_parts(spark, folder):
    archive = F.concat("url", F.lit(".tar.zip"))
    source = F.concat("url", F.lit(".py"))
    return table(spark, folder, "pages").select(
        "page_id",
        T.file_stem(archive).alias("stem"),
        T.has_suffix(source, (".pyi", ".py")).alias("is_source"),
    )


@query(
    "first_line_comment",
    r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '^([^\r\n]*)', 1) AS line FROM documents),
             m AS (SELECT *, regexp_matches(line, '^[ \t]*The') AS hit FROM d)
        SELECT doc_id,
               CASE WHEN hit THEN nullif(regexp_replace(regexp_replace(line, '^[ \t]*(The)+', ''),
                    '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '') END AS comment,
               md5(regexp_replace(CASE WHEN hit THEN regexp_replace(text, '^[^\r\n]*(\r\n|\r|\n)?', '')
                    ELSE text END, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) AS body
        FROM m""",
)
def first_line_comment(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        T.leading_comment(F.col("text"), "The").alias("comment"),
        F.md5(T.without_leading_comment(F.col("text"), "The")).alias("body"),
    )


_TFIDF = r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term
                     FROM documents),
     tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
     f AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf
           FROM tf GROUP BY term),
     raw AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN f USING (term)),
     w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight
           FROM raw)
"""


def _texts(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


@query(
    "term_counts",
    r"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (
          SELECT doc_id, term, count(*) AS tf FROM (
            SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term
            FROM documents) GROUP BY ALL) GROUP BY term""",
)
def term_counts(spark, folder):
    postings = M.term_counts(_texts(spark, folder), "doc_id", "text")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(
    "tfidf_top_terms",
    _TFIDF
    + """SELECT doc_id, term, round(weight, 6) + 0e0 AS weight FROM w
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 5""",
)
def tfidf_top_terms(spark, folder):
    weights = M.tfidf(_texts(spark, folder), "doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    top = weights.withColumn("rank", rank).where("rank <= 5")
    return top.select("doc_id", "term", r6("weight").alias("weight"))


_TYPED = "The licensed work, by any person: the the a work and license"


@query(
    "text_search_impacts",
    _TFIDF
    + f""", q AS (SELECT unnest(regexp_extract_all(lower('{_TYPED}'), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term),
         c AS (SELECT term, count(*) AS tf FROM q GROUP BY term),
         i AS (SELECT term, tf * (ln((1e0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw
               FROM c JOIN (SELECT term, count(*) AS df FROM w GROUP BY term) USING (term)),
         n AS (SELECT term, raw / sqrt(sum(raw * raw) OVER ()) AS own FROM i),
         s AS (SELECT doc_id, sum(weight * own) AS score FROM w JOIN n USING (term) GROUP BY doc_id)
         SELECT doc_id, round(score, 6) + 0e0 AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 40""",
)
def text_search_impacts(spark, folder):
    """The best of all documents by the cosine of their TF-IDF weights, on the impact index."""
    docs = _texts(spark, folder)
    index = build_impacts(docs, scratch_path(spark, "impacts"), "doc_id")
    return index.search(_TYPED, 40).select("doc_id", r6("score").alias("score"))


@query(
    "tfidf_vectors",
    _TFIDF
    + """, v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS col FROM f)
         SELECT d.doc_id, count(term) AS filled, CAST(coalesce(sum(col), 0) AS BIGINT) AS columns,
                round(coalesce(sum(weight * (1 + col % 97)), 0), 4) + 0e0 AS mixed
         FROM documents d LEFT JOIN (w JOIN v USING (term)) ON d.doc_id = w.doc_id
         GROUP BY d.doc_id""",
)
def tfidf_vectors(spark, folder):
    vectors, _ = M.tfidf_vectors(_texts(spark, folder), "doc_id", "text")
    parts = vectors.select("doc_id", F.unwrap_udt("features").alias("v")).select("doc_id", "v.*")
    columns = F.transform("indices", lambda i: i.cast("bigint"))
    mixed = F.zip_with("values", columns, lambda x, i: x * (1 + i % 97))
    total = lambda array, zero: F.aggregate(array, F.lit(zero), lambda s, x: s + x)
    return parts.select(
        "doc_id",
        F.size("indices").cast("bigint").alias("filled"),
        F.aggregate(columns, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("columns"),
        (F.round(total(mixed, 0.0), 4) + F.lit(0.0)).alias("mixed"),
    )


@query(
    "tfidf_profile",
    _TFIDF
    + """SELECT doc_id, count(*) AS terms, round(sum(weight), 6) + 0e0 AS total,
                round(sum(weight * weight), 6) + 0e0 AS squares FROM w GROUP BY doc_id""",
)
def tfidf_profile(spark, folder):
    weights = M.tfidf(table(spark, folder, "documents"), "doc_id", "text")
    return weights.groupBy("doc_id").agg(
        F.count("*").alias("terms"),
        r6(F.sum("weight")).alias("total"),
        r6(F.sum(F.col("weight") * F.col("weight"))).alias("squares"),
    )


# Source text made from the documents: a class with a documented method that
# holds another function, an async function, and one helper that is the same
# in every file of a language. German documents do not parse.
_PROSE = "trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"


def _source_files(spark, folder):
    prose = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    lines = [
        F.lit("import os\n\nclass Document:\n    def first_"),
        F.col("doc_id"),
        F.lit("(self, count: int, lang='"),
        F.col("lang"),
        F.lit("', *rest, flag=True):\n        '''"),
        prose,
        F.lit("'''\n        # a remark\n        def inner(x=1, /, y=2): return x\n        total = count + "),
        F.col("n_chars"),
        F.lit("\n        return total\n\nasync def later(): pass\n\ndef shared_"),
        F.col("lang"),
        F.when(F.col("lang") == "de", F.lit("(a, b:\n")).otherwise(F.lit("(a, b):\n")),
        F.lit("    return (a +\n            b)\n"),
    ]
    docs = spread(table(spark, folder, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.substring("source", 4, 9).cast("bigint").alias("repo"),
        F.concat(*lines).alias("content"),
    )


_FUNCTIONS = f"""WITH d AS (SELECT doc_id, lang, n_chars, CAST(substring(source, 4) AS BIGINT) AS repo,
                     {_PROSE} AS prose FROM documents WHERE lang <> 'de'),
    f AS (
      SELECT doc_id AS file_id, repo, 'first_' || doc_id AS name, 'self,count,lang' AS args,
             'int' AS args_types, '''' || lang || '''' AS args_defaults,
             (CASE WHEN prose = '' THEN '''''' || chr(10) ELSE '' END) ||
             'def inner(x=1, /, y=2):' || chr(10) || '    return x' || chr(10) ||
             'total = count + ' || n_chars || chr(10) || 'return total' AS body,
             nullif(prose, '') AS docstring, 4 AS lineno FROM d
      UNION ALL
      SELECT doc_id, repo, 'inner', 'y', '', '1,2', 'return x', NULL, 7 FROM d
      UNION ALL
      SELECT doc_id, repo, 'shared_' || lang, 'a,b', '', '', 'return a + b', NULL, 13 FROM d)
"""


def _flat(functions):
    return functions.select(
        *[c for c in ("id", "file_id", "repo", "name") if c in functions.columns],
        *[F.array_join(c, ",").alias(c) for c in ("args", "args_types", "args_defaults")],
        "body",
        "docstring",
        "lineno",
    )


@query("extract_functions", _FUNCTIONS + "SELECT * FROM f")
def extract_functions(spark, folder):
    extracted = corpus.extract_functions(_source_files(spark, folder))
    return _flat(extracted.where(F.col("error").isNull()))


@query(
    "extract_rejects",
    "SELECT 'SyntaxError' AS error, count(*) AS files FROM documents WHERE lang = 'de' HAVING files > 0",
)
def extract_rejects(spark, folder):
    return corpus.reject_counts(corpus.extract_functions(_source_files(spark, folder)))


@query(
    "functions_table",
    _FUNCTIONS
    + """, u AS (SELECT * FROM f QUALIFY row_number() OVER (
                   PARTITION BY body, name ORDER BY file_id, lineno) = 1)
         SELECT row_number() OVER (ORDER BY file_id, lineno, name) AS id, * FROM u""",
)
def functions_table(spark, folder):
    files = _source_files(spark, folder).withColumnRenamed("file_id", "id")
    functions, _ = corpus.functions_table(files)
    return _flat(functions)


@query(
    "split_bodies",
    f"""SELECT doc_id, CASE WHEN lang = 'de' THEN 'x = (' WHEN lang = 'fr' THEN 'x = 1'
                            WHEN {_PROSE} = '' THEN repeat(chr(34), 6) || chr(10) || 'return ' || n_chars
                            ELSE 'return ' || n_chars END AS body,
               CASE WHEN lang = 'de' THEN NULL ELSE nullif({_PROSE}, '') END AS docstring
        FROM documents""",
)
def split_bodies(spark, folder):
    prose = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    body = (
        F.when(F.col("lang") == "de", F.lit("x = ("))
        .when(F.col("lang") == "fr", F.concat(F.lit("  # "), prose, F.lit("\nx = 1")))
        .otherwise(F.concat(F.lit('"""'), prose, F.lit('"""\nreturn '), F.col("n_chars")))
    )
    bodies = table(spark, folder, "documents")
    return bodies.select("doc_id", body.alias("raw")).lateralJoin(
        BodySplit(F.col("raw").outer())
    ).drop("raw")
