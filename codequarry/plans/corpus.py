"""From repository metadata and archives to the table of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.source_code import FunctionsIn
from codequarry.functions.text import archive_url, first_link, preferred_branch, repo_slug
from codequarry.operators.aggregates import dedup_first
from codequarry.operators.joins import attach_repo
from codequarry.operators.rows import with_row_index
from codequarry.session import durable, small_batches
from codequarry.sources.archives import read_zip_members

# Source files that a task parses before it hands on what it found.
PARSE_ROWS = 256
FUNCTION_COLUMNS = ("name", "args", "args_types", "args_defaults", "body", "docstring", "lineno")


def project_repos(pages: DataFrame, html: str = "html", host: str = "github.com") -> DataFrame:
    """Project pages with the repository each links to first, NULL where none."""
    return pages.withColumn("repo", repo_slug(first_link(F.col(html), host)))


def with_branch(repos: DataFrame) -> DataFrame:
    """Repositories with name and link of the branch to download.

    ``repos`` has ``branches array<struct<name, commit struct<url>>>`` and
    ``default_branch``.
    """
    picked = preferred_branch(F.col("branches"), F.col("default_branch"))
    return (
        repos.withColumn("_branch", picked)
        .withColumn("branch_name", F.col("_branch.name"))
        .withColumn("branch_url", F.col("_branch.commit.url"))
        .drop("_branch", "branches")
    )


def archive_links(repos: DataFrame) -> DataFrame:
    """(name, url) of every archive to fetch; rows lacking either are left out."""
    usable = F.col("name").isNotNull() & F.col("branch_url").isNotNull()
    return repos.where(usable).select("name", archive_url(F.col("branch_url")).alias("url"))


def files_table(spark: SparkSession, archives: str, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, unreadable archives).

    ``files`` is (id, repo, file, content). Ids are given here, once, in order
    of archive and file.
    """
    members = durable(read_zip_members(spark, archives))
    bad = members.where("status <> 'ok'").select("archive", "status")
    good = attach_repo(members.where("status = 'ok'"), repos)
    numbered = with_row_index(good, ["archive", "file"], "id")
    return numbered.select((F.col("id") + 1).alias("id"), "repo", "file", "content"), bad


def extract_functions(
    files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file_id", "repo")
) -> DataFrame:
    """One row per function, and one with ``error`` set per file that does not parse.

    The other columns of a file travel with its functions. A file without
    functions gives no row.
    """
    small_batches(files.sparkSession, PARSE_ROWS)
    found = FunctionsIn(F.col(content).outer())
    return files.lateralJoin(found).select(*keep, *FUNCTION_COLUMNS, "error")


def reject_counts(extracted: DataFrame) -> DataFrame:
    """(error, files) for the files that gave no functions because of an error."""
    return (
        extracted.where(F.col("error").isNotNull())
        .groupBy("error")
        .agg(F.count("*").alias("files"))
    )


def unique_functions(extracted: DataFrame) -> DataFrame:
    """Functions without repeats of (body, name); the first file and line wins."""
    found = extracted.where(F.col("error").isNull()).drop("error")
    return dedup_first(found, ["body", "name"], ["file_id", "lineno"])


def functions_table(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions, reject counts) of a files table (id, repo, content).

    Parsing is the dear step and its result is read three times, so it is
    written to the shared folder once.
    """
    extracted = durable(extract_functions(files.withColumnRenamed("id", "file_id")))
    numbered = with_row_index(unique_functions(extracted), ["file_id", "lineno", "name"], "id")
    functions = numbered.select((F.col("id") + 1).alias("id"), "file_id", "repo", *FUNCTION_COLUMNS)
    return functions, reject_counts(extracted)
