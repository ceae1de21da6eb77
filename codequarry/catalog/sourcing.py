"""Sources and sinks, on files that Spark writes from the test tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from codequarry.catalog import query, r6, table, vectors
from codequarry.session import scratch_path
from codequarry.sources import archives, tables
from codequarry.sources import vectors as vector_io


@query(
    "json_props",
    """SELECT event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""",
)
def json_props(spark, folder):
    parsed = table(spark, folder, "events").withColumn("p", F.from_json("props", "k int"))
    return parsed.select("event_id", F.col("event_type").alias("kind"), F.col("p.k"))


@query(
    "json_rows",
    """SELECT lang AS last_update, word AS project, count(*) AS n,
              CAST(sum(length(word)) AS BIGINT) AS download_count
       FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL""",
)
def json_rows(spark, folder):
    path = scratch_path(spark, "json-rows")
    row = F.transform(
        F.split("text", " "),
        lambda word: F.struct(word.alias("project"), F.length(word).alias("download_count")),
    )
    documents = table(spark, folder, "documents")
    documents.select(F.col("lang").alias("last_update"), row.alias("rows")).write.json(path)
    schema = "last_update string, rows array<struct<project: string, download_count: bigint>>"
    words = tables.read_json_rows(spark, path, schema=schema, multi_line=False)
    return words.groupBy("last_update", "project").agg(
        F.count("*").alias("n"), F.sum("download_count").alias("download_count")
    )


@query(
    "json_records",
    """SELECT page_id, length(html) AS size, string_split(url, '/')[3] AS host
       FROM pages WHERE starts_with(url, 'https')""",
)
def json_records(spark, folder):
    path = scratch_path(spark, "json-records")
    record = F.to_json(
        F.struct(
            "page_id",
            F.struct(F.length("html").alias("size"), F.split("url", "/")[2].alias("host")).alias(
                "page"
            ),
        )
    )
    line = F.when(F.startswith("url", F.lit("https")), record).otherwise("null")
    table(spark, folder, "pages").select(line.alias("value")).write.text(path)
    schema = "page_id bigint, page struct<size: bigint, host: string>"
    return tables.read_records(spark, path, schema).select("page_id", "page.size", "page.host")


@query(
    "json_record_rejects",
    """SELECT CASE WHEN starts_with(url, 'https') THEN 'record' ELSE 'reject' END AS kind,
              count(*) AS n, CAST(sum(page_id) AS BIGINT) AS ids FROM pages GROUP BY 1""",
)
def json_record_rejects(spark, folder):
    """Lines cut short among whole ones: no record from them, and all of them listed."""
    path = scratch_path(spark, "json-rejects")
    record = F.to_json(F.struct("page_id", F.length("html").alias("size")))
    short = F.concat(F.lit('{"page_id": '), F.col("page_id").cast("string"), F.lit(', "size": '))
    line = F.when(F.startswith("url", F.lit("https")), record).otherwise(short)
    table(spark, folder, "pages").select(line.alias("value")).write.text(path)
    good = tables.read_records(spark, path, "page_id bigint, size bigint").select(
        F.lit("record").alias("kind"), "page_id"
    )
    number = F.regexp_extract("value", "[0-9]+", 0).cast("bigint").alias("page_id")
    bad = tables.json_rejects(spark, path).select(F.lit("reject").alias("kind"), number)
    counts = good.union(bad).groupBy("kind")
    return counts.agg(F.count("*").alias("n"), F.sum("page_id").alias("ids"))


@query(
    "csv_stitch",
    """WITH slices AS (
         SELECT source || '/' || n_chars AS full_name, n_chars::VARCHAR AS size, NULL AS lang,
                NULL AS topics, 0 AS slice, doc_id FROM documents WHERE lang = 'en'
         UNION ALL
         SELECT source || '/' || n_chars, n_chars::VARCHAR, lang,
                '["' || lang || '","say \\"hi\\""]', 1, doc_id FROM documents WHERE lang <> 'en')
       SELECT full_name, size, lang, topics FROM slices
       QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY slice, doc_id) = 1""",
)
def csv_stitch(spark, folder):
    path = scratch_path(spark, "csv-slices")
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("_c0"),
        F.concat("source", F.lit("/"), "n_chars").alias("full_name"),
        F.col("n_chars").alias("size"),
        "lang",
        F.array(F.col("lang"), F.lit('say "hi"')).alias("topics"),
    )
    # Sorted, so that files of a slice and rows of a file are in saved order.
    ordered = docs.orderBy("_c0")
    tables.write_csv(ordered.where("lang = 'en'").drop("lang", "topics"), f"{path}/a")
    tables.write_csv(ordered.where("lang <> 'en'"), f"{path}/b")
    return tables.stitch_csv(spark, [f"{path}/a/*.csv", f"{path}/b/*.csv"], "full_name")


@query(
    "table_roundtrip",
    "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) + 0e0 AS o_totalprice FROM orders",
)
def table_roundtrip(spark, folder):
    path = scratch_path(spark, "orders")
    tables.write_table(table(spark, folder, "orders"), path, rows_per_file=1_000_000)
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    back = tables.read_table(spark, path, columns, "o_orderkey", 8)
    return back.withColumn("o_totalprice", F.round("o_totalprice", 2) + F.lit(0.0))


_ARCHIVE_SQL = """SELECT doc_id, CASE WHEN lang <> 'de' THEN 'src/doc_' || doc_id || '.py' END AS file,
       CASE WHEN lang <> 'de' THEN md5(text) END AS digest,
       CASE WHEN lang <> 'de' THEN 'ok' ELSE 'unreadable: BadZipFile' END AS status
FROM documents"""


def _archive(doc_id: int, lang: str, text: str) -> bytes:
    if lang == "de":
        return text.encode()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        # bytes that are no UTF-8 are dropped on reading
        out.writestr(f"src/doc_{doc_id}.py", b"\xff" + text.encode() + b"\xfe")
        out.writestr("README.md", text)
        out.writestr(".py", text)
    return buffer.getvalue()


@query("zip_members", _ARCHIVE_SQL)
def zip_members(spark, folder):
    @F.pandas_udf("binary")
    def zipped(doc_id: pd.Series, lang: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([_archive(*row) for row in zip(doc_id, lang, text)])

    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    packed = docs.select("doc_id", zipped("doc_id", "lang", "text").alias("data"))
    members = archives.unpack_archives(packed, "data", ["doc_id"])
    return members.select("doc_id", "file", F.md5("content").alias("digest"), "status")


@query(
    "vector_roundtrip",
    """SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 6) + 0e0 AS total
       FROM embeddings WHERE label <> 3""",
)
def vector_roundtrip(spark, folder):
    path = scratch_path(spark, "vectors")
    vector_io.write_vectors(_ragged(spark, folder), path)
    back = vector_io.read_vectors(spark, path, 64)
    return back.select("id", r6(_total("vec")).alias("total"))


def _total(vec: str):
    return F.aggregate(vec, F.lit(0.0), lambda total, x: total + x.cast("double"))


def _ragged(spark, folder):
    """Vectors of label 3 cut short, as doubles."""
    points = vectors(spark, folder)
    cut = F.when(F.col("label") == 3, F.slice("vec", 1, 10)).otherwise(F.col("vec"))
    return points.withColumn("vec", cut.cast("array<double>"))


@query(
    "vector_dim_check",
    """SELECT count(*) FILTER (WHERE label <> 3) AS kept,
              count(*) FILTER (WHERE label = 3) AS rejected FROM embeddings""",
)
def vector_dim_check(spark, folder):
    return vector_io.vector_reject_counts(_ragged(spark, folder), 64)


# Numbers in a vector of the test tables.
WIDTH = 64
_WIDE = ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) + 0e0 AS c{i}" for i in range(WIDTH))


@query("vector_wide", f"SELECT vec_id AS id, {_WIDE} FROM embeddings")
def vector_wide(spark, folder):
    wide = vector_io.vector_to_columns(vectors(spark, folder).drop("label"), WIDTH)
    columns = [r6(F.col(f"c{i}").cast("double")).alias(f"c{i}") for i in range(WIDTH)]
    return wide.select("id", *columns)


@query(
    "vector_from_columns",
    "SELECT vec_id AS id, len(embedding) AS dim, md5(embedding::VARCHAR) IS NOT NULL AS whole FROM embeddings",
)
def vector_from_columns(spark, folder):
    points = vectors(spark, folder).select("id", "vec", F.col("vec").alias("old"))
    wide = vector_io.vector_to_columns(points, 64)
    back = vector_io.columns_to_vector(wide, [f"c{i}" for i in range(64)])
    return back.select(
        "id", F.size("vec").cast("bigint").alias("dim"), (F.col("vec") == F.col("old")).alias("whole")
    )


@query("import_positional", "SELECT vec_id + 1 AS id, label FROM embeddings")
def import_positional(spark, folder):
    saved = vectors(spark, folder).select(F.col("id").alias("position"), "label")
    return vector_io.import_positional(saved, "position")
