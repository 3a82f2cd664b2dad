"""Archives and folders of documents as Python data sources, with filters pushed to them, and archives read by many tasks.

`register(spark)` makes two formats known:
* `archive_members`: the members of tar archives (plain, gz, bz2, xz) with the place of their content; a partition for each archive, which reads headers alone
  where the archive is plain;
* `document_files`: the files below a folder, of which each partition reads a share of the bytes.
Both take `path` (a file, a folder or a URI of a file system that pyarrow knows) and push down filters on path (equality, IN, beginning, end) and on extension
(equality, IN): what they rule out isn't opened.

`read_archives` deals the members of plain archives out by their bytes, so one large archive is read by several tasks; a compressed archive can only be read from its
beginning, so it is one task's, member by member. Members that aren't regular files are left out, as are archives' first folders from the paths. Of
repeated members of one path the last in the archive counts, as in unpacking.
"""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

from sheaf.functions.text import replace
from sheaf.sources.files import EXTENSIONS, wanted

#: Bytes of documents that a task reads.
SHARE = 32 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files at or below a path, in order."""
    system, place = located(path)
    info = system.get_file_info(place)
    found = system.get_file_info(pafs.FileSelector(place, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File)


def extension_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1]


class Filtered(DataSourceReader):
    """A reader that takes filters on path and extension."""

    def __init__(self, options: dict):
        self.path, self.share, self.tests = options["path"], int(options.get("share", SHARE)), []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("path", "extension") and isinstance(f, (EqualTo, In)) or column == "path" and isinstance(f, (StringStartsWith, StringEndsWith)):
                self.tests.append(f)
            else:
                yield f

    def keeps(self, path: str) -> bool:
        for f in self.tests:
            value = path if f.attribute[0] == "path" else extension_of(path)
            ok = value == f.value if isinstance(f, EqualTo) else value in f.value if isinstance(f, In) else value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value)
            if not ok:
                return False
        return True


@dataclass
class Archive(InputPartition):
    path: str


class MemberReader(Filtered):
    def partitions(self):
        return [Archive(p) for p, _ in files_below(self.path)]

    def read(self, partition: Archive) -> Iterator[tuple]:
        with opened(self.path, partition.path) as (tar, plain):
            for n, member in enumerate(tar):
                if member.isfile() and self.keeps(member.name):
                    yield partition.path, n, member.name, extension_of(member.name), member.size, member.offset_data if plain else None


class opened:  # noqa: N801  used like open()
    """A tar archive as (archive, whether it is plain): headers of plain ones are read by seeking, others as a stream."""

    def __init__(self, near: str, path: str):
        system, _ = located(near)
        self.raw = system.open_input_file(path)
        begin = self.raw.read(6)
        self.raw.seek(0)
        self.plain = not begin.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ"))

    def __enter__(self):
        self.tar = tarfile.open(fileobj=self.raw, mode="r:" if self.plain else "r|*")
        return self.tar, self.plain

    def __exit__(self, *_):
        self.tar.close()
        self.raw.close()


class ArchiveMembers(DataSource):
    """The members of tar archives: archive, n, path, extension, size, offset (null in compressed ones)."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, n long, path string, extension string, size long, offset long"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(dict(self.options))


@dataclass
class Share(InputPartition):
    paths: list


class FileReader(Filtered):
    def partitions(self):
        out, size = [[]], 0
        _, root = located(self.path)
        for path, n in files_below(self.path):
            name = path[len(root) :].lstrip("/") or path.rsplit("/", 1)[-1]
            if self.keeps(name):
                if out[-1] and size + n > self.share:
                    out.append([])
                    size = 0
                out[-1].append((path, name))
                size += n
        return [Share(p) for p in out]

    def read(self, partition: Share) -> Iterator[tuple]:
        system, _ = located(self.path)
        for path, name in partition.paths:
            with system.open_input_stream(path, compression=None) as f:
                yield name, extension_of(name), f.read().decode("utf-8", "replace")


class DocumentFiles(DataSource):
    """The files below a folder: path, relative to it, extension, content."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "path string, extension string, content string"

    def reader(self, schema) -> DataSourceReader:
        return FileReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session. Filters reach them if spark.sql.python.filterPushdown.enabled is set."""
    for source in (ArchiveMembers, DocumentFiles):
        spark.dataSource.register(source)


def members(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("archive_members").option("path", path).load()


def read_archives(spark: SparkSession, path: str, source: str, extensions: tuple[str, ...] | None = EXTENSIONS, share: int = SHARE) -> DataFrame:
    """(source, path, content) of the files in tar archives below a path, without their first folder."""
    found = members(spark, path)
    if extensions is not None:
        found = found.where(F.col("extension").isin(*extensions))
    # the last of a path in its archive
    last = found.groupBy("archive", "path").agg(F.max(F.struct("n", "size", "offset")).alias("m")).select("archive", "path", "m.n", "m.size", "m.offset")
    # plain archives by shares of their bytes, compressed ones whole
    part = F.when(F.col("offset").isNotNull(), (F.col("offset") / share).cast("long")).otherwise(-1)
    dealt = last.withColumn("part", part).repartition("archive", "part").sortWithinPartitions("archive", "n")

    def read(batches):
        for batch in batches:
            for archive, own in batch.groupby("archive", sort=False):
                yield from content(archive, own)

    def content(archive: str, own: pd.DataFrame):
        system, _ = located(path)
        if own["offset"].notna().all():
            with system.open_input_file(archive) as f:
                for name, size, offset in zip(own["path"], own["size"], own["offset"], strict=True):
                    f.seek(int(offset))
                    yield pd.DataFrame({"path": [name], "content": [f.read(int(size)).decode("utf-8", "replace")]})
        else:
            asked = dict(zip(own["n"], own["path"], strict=True))
            with opened(path, archive) as (tar, _):
                for n, member in enumerate(tar):
                    if n in asked:
                        yield pd.DataFrame({"path": [asked[n]], "content": [tar.extractfile(member).read().decode("utf-8", "replace")]})

    rows = dealt.select("archive", "n", "path", "size", "offset").mapInPandas(read, "path string, content string")
    rows = rows.withColumn("path", replace("path", r"\A(?:\./)?[^/]+/"))
    return wanted(rows.select(F.lit(source).alias("source"), "path", "content"), extensions)


def scan_files(spark: SparkSession, path: str, source: str, extensions: tuple[str, ...] | None = EXTENSIONS) -> DataFrame:
    """(source, path, content) of the files below a folder, paths relative to it."""
    register(spark)
    rows = spark.read.format("document_files").option("path", path).load()
    if extensions is not None:
        rows = rows.where(F.col("extension").isin(*extensions))
    return wanted(rows.select(F.lit(source).alias("source"), "path", "content"), extensions)
