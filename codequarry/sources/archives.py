"""ZIP archives of source files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.text import file_stem

# Fixed value: the suffixes of the members that are kept.
SOURCE_SUFFIXES = (".py",)


MEMBER = "file string, content string, status string"


def members_of(archive: BinaryIO, suffixes: Sequence[str]) -> Iterator[tuple]:
    """(file, content, status) of the members kept, one at a time.

    A member that cannot be read is reported by name, and so is an archive
    that cannot be opened, without one; neither ends the others.
    """
    try:
        with zipfile.ZipFile(archive) as opened:
            # A name listed twice is read once, as its last version.
            for name in dict.fromkeys(opened.namelist()):
                if PurePosixPath(name).suffix not in suffixes:
                    continue
                try:
                    yield name, opened.read(name).decode("utf-8", errors="ignore"), "ok"
                except Exception as problem:
                    yield name, None, f"unreadable: {type(problem).__name__}"
    except Exception as problem:
        # pyarrow's own word for a file too short to hold a directory
        kind = zipfile.BadZipFile if isinstance(problem, pa.ArrowInvalid) else type(problem)
        yield None, None, f"unreadable: {kind.__name__}"


@F.udtf(returnType=MEMBER, useArrow=True)
class ZipMembers:
    """``LATERAL`` table function: archive bytes to its text members."""

    def eval(self, data: bytes, suffixes: list[str]) -> Iterator[tuple]:
        if data is not None:
            yield from members_of(io.BytesIO(data), suffixes)


@F.udtf(returnType=MEMBER, useArrow=True)
class ZipFileMembers:
    """``LATERAL`` table function: the place of an archive to its text members."""

    def eval(self, uri: str, suffixes: list[str]) -> Iterator[tuple]:
        try:
            store, path = pyarrow.fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as archive:
                yield from members_of(archive, suffixes)
        except Exception as problem:
            yield None, None, f"unreadable: {type(problem).__name__}"


def unpack_archives(
    archives: DataFrame, data: str, keep: Sequence[str], suffixes: Sequence[str] = SOURCE_SUFFIXES
) -> DataFrame:
    """Members of archives held in a binary column, with the ``keep`` columns.

    An archive that cannot be read gives a row with a NULL ``file`` and the
    reason in ``status``.
    """
    wanted = F.array(*[F.lit(suffix) for suffix in suffixes])
    members = ZipMembers(F.col(data).outer(), wanted)
    return archives.lateralJoin(members).select(*keep, "file", "content", "status")


def read_zip_members(
    spark: SparkSession, glob: str, suffixes: Sequence[str] = SOURCE_SUFFIXES
) -> DataFrame:
    """(archive, file, content, status) for every archive under ``glob``, of any size.

    Only places are listed here. The task that gets one opens it where it
    lies, in any store that pyarrow reads, and takes members out one by one;
    for other stores read the bytes and give them to :func:`unpack_archives`.
    """
    found = spark.read.format("binaryFile").load(glob).select("path")
    wanted = F.array(*[F.lit(suffix) for suffix in suffixes])
    place = F.regexp_replace("path", "^file:/(?!/)", "file:///")
    members = ZipFileMembers(place.outer(), wanted)
    stem: Column = file_stem(F.col("path")).alias("archive")
    return found.lateralJoin(members).select(stem, "file", "content", "status")
