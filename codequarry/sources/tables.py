"""Table, CSV, JSON and JDBC sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.operators.aggregates import dedup_first
from codequarry.operators.rows import union_fill

# pandas writes quotes inside a field doubled; Spark's default is a backslash.
_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def _is_path(name: str) -> bool:
    return "/" in name


def read_table(
    spark: SparkSession,
    name: str,
    columns: Sequence[str] | None = None,
    key: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """A parquet path or a catalog table, optionally spread by ``key``."""
    df = spark.read.parquet(name) if _is_path(name) else spark.table(name)
    if columns is not None:
        df = df.select(*columns)
    if partitions is not None:
        df = df.repartition(partitions, *([key] if key else []))
    return df


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table read in ``partitions`` ranges of its integer ``key``.

    One aggregate query fetches the key range first. The driver class and the
    credentials come from the caller through ``properties``.
    """
    props = properties or {}
    bounds = spark.read.jdbc(
        url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) key_range", properties=props
    ).first()
    if bounds is None or bounds[0] is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(
        url,
        table,
        column=key,
        lowerBound=int(bounds[0]),
        upperBound=int(bounds[1]) + 1,
        numPartitions=partitions,
        properties=props,
    )


def _plain(path: str) -> str:
    """A path without scheme and host, for comparing places."""
    rest = path.split(":", 1)[1] if ":" in path.split("/", 1)[0] else path
    return "/" + rest.lstrip("/").rstrip("/")


def write_table(
    df: DataFrame, target: str, mode: str = "overwrite", rows_per_file: int | None = None
) -> None:
    """Write a parquet path or a catalog table, replacing it by default.

    Overwriting the files a frame is read from would destroy them before they
    are read, so that is refused.
    """
    spark = df.sparkSession
    if mode == "overwrite":
        if _is_path(target):
            places = [_plain(target)]
        elif spark.catalog.tableExists(target):
            places = [_plain(unquote(f)) for f in spark.table(target).inputFiles()]
        else:
            places = []
        for source in (_plain(unquote(file)) for file in df.inputFiles()):
            if any(source == place or source.startswith(place + "/") for place in places):
                raise ValueError(f"refusing to overwrite {target}: it is being read")
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if _is_path(target):
        writer.parquet(target)
    else:
        writer.saveAsTable(target)


def read_json_rows(
    spark: SparkSession,
    path: str,
    rows_field: str = "rows",
    meta: Sequence[str] = ("last_update",),
    schema: str | T.StructType | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """One row per element of the array in a JSON document, plus its metadata.

    A file is one document, or with ``multi_line=False`` one per line; a
    document per line lets Spark cut files, a document per file does not.
    Documents that are no JSON have no rows: :func:`json_rejects` lists them.
    """
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    document = reader.json(path)
    kept = [F.col(name) for name in meta if name in document.columns]
    return document.select(F.explode(rows_field).alias("r"), *kept).select("r.*", *kept)


def read_records(
    spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = False
) -> DataFrame:
    """JSON records under a stated schema; records that are ``null`` are dropped.

    One record per line, or with ``multi_line=True`` an array of them per file.
    Spark's own reader rejects an array holding a ``null``, so the array is
    parsed as a value. What is no JSON gives no record: :func:`json_rejects`
    lists it.
    """
    record = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    text = _json_texts(spark, path, multi_line)
    if multi_line:
        items = F.from_json("value", T.ArrayType(record))
        return text.select(F.explode(items).alias("r")).where("r IS NOT NULL").select("r.*")
    parsed = text.where(_is_json(F.col("value"))).select(F.from_json("value", record).alias("r"))
    return parsed.select("r.*")


def _json_texts(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    text = spark.read.text(path, wholetext=multi_line)
    return text.select(F.col("_metadata.file_path").alias("file"), "value").where(
        ~F.trim("value").isin("", "null")
    )


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def json_rejects(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, value) of every line, or with ``multi_line`` every file, that is no JSON."""
    text = _json_texts(spark, path, multi_line)
    return text.where(~_is_json(F.col("value")))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; nested columns are written as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    columns = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*columns).write.mode(mode).options(header="true", quote='"', escape='"').csv(path)


def _headers(spark: SparkSession, glob: str) -> list[tuple[str, str]]:
    """(file, first line) of every file under ``glob``, in one job."""
    lines = spark.read.text(glob).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    firsts = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return [(row.file, row.header) for row in firsts.orderBy("file").collect()]


def stitch_csv(
    spark: SparkSession,
    globs: Sequence[str],
    key: str | None = None,
    index_column: str = "_c0",
) -> DataFrame:
    """Union of CSV slices, first row per ``key``, saved index column dropped.

    Files whose headers differ are united by column name and filled with NULL;
    files of one glob that share a header are read together. The order that
    decides which row is first: globs as listed, then file name, then the
    saved index. Columns stay text; the caller casts. A blank header name
    reads as ``_c0``.
    """
    seen: set[str] = set()
    parts = []
    for position, glob in enumerate(globs):
        by_header: dict[str, list[str]] = {}
        for file, header in _headers(spark, glob):
            if file not in seen:
                seen.add(file)
                by_header.setdefault(header, []).append(file)
        for files in by_header.values():
            part = spark.read.options(**_CSV).csv([unquote(file) for file in files])
            indexed = index_column in part.columns
            parts.append(
                part.select(
                    "*",
                    F.lit(position).alias("_glob"),
                    F.col("_metadata.file_path").alias("_file"),
                    (F.col(index_column).cast("bigint") if indexed else F.lit(0)).alias("_row"),
                ).drop(index_column)
            )
    if not parts:
        raise FileNotFoundError(f"no CSV files match {list(globs)}")
    united = reduce(union_fill, parts)
    if key is not None:
        united = dedup_first(united, [key], ["_glob", "_file", "_row"])
    return united.drop("_glob", "_file", "_row")
