"""Session settings and the shared folder for intermediate data."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "codequarry",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the library is tested under.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset and let
    spark-submit decide; adaptive execution then sizes the shuffles.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="codequarry-package-")) / "codequarry"
        archive = shutil.make_archive(str(base), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Without one nothing may be written that another executor has to read, so
    that is an error. A local master has one machine, and gets a folder there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="codequarry-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files: the copy that it writes is all that later steps read."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the copy.

    Used where a plan is read several times and recomputing it is dear. The
    copy outlives the executors that wrote it.
    """
    checkpoint_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As :func:`durable`, in Parquet, which is smaller and read by column; tasks and their order are not kept."""
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``df`` as Parquet; its shuffle files go as soon as it is written."""
    with _shuffles_dropped(df.sparkSession):
        df.write.mode(mode).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` gave, once nothing will read it again."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int) -> None:
    """Give Python steps ``rows`` rows at a time at most; Spark's 10,000 are too many where rows are texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name))
    if own <= 0 or own > rows:
        spark.conf.set(name, str(rows))
