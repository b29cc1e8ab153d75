"""Zip archives as a data source, and as a sink.

A partition is an archive and a range of its bytes: its task reads the archive's directory and unpacks the members that begin
in the range, so one archive is read by many tasks, and the driver knows nothing but names and sizes. ``lines`` says how much
of a member is unpacked: 0 nothing (content is null), n the first n lines, unset all of it. Filters ``stem = …`` and
``stem in (…)`` are pushed down, so that other members aren't unpacked.

Defined results: of members with one stem in an archive the last in its directory counts; license files and folders are left
out; bytes that aren't UTF-8 become U+FFFD; an archive without members gives no rows; a path without archives, or a file that
is no archive, fails. A member lies whole in a row.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .tables import with_package

FORMAT = "zip_members"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SPLIT_BYTES = 32 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512
COLUMNS = ["archive", "stem", "content"]


@dataclass
class Range(InputPartition):
    """The members of an archive that begin at lo or later and before hi."""

    path: str
    lo: int
    hi: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def archives_of(path: str) -> list[tuple[str, int]]:
    """(archive, bytes) of a file, of the .zip files below a folder, or of a pattern in the last part of a path."""
    system, inner = _system(path)
    head, last = posixpath.split(inner)
    pattern = last if any(c in last for c in "*?[") else None
    at = system.get_file_info(head if pattern else inner)
    if at.type == fs.FileType.File:
        return [(path, at.size)]
    root = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if at.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = system.get_file_info(fs.FileSelector(at.path, recursive=pattern is None))
    found = [(root + f.path, f.size) for f in below if f.is_file and (fnmatch.fnmatch(f.base_name, pattern) if pattern else f.base_name.lower().endswith(".zip"))]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def wanted(directory: list[zipfile.ZipInfo], suffix: str) -> dict[str, zipfile.ZipInfo]:
    """Members with this suffix in any case, by stem."""
    named = {}
    for info in directory:
        base = info.filename.rsplit("/", 1)[-1]
        if base and base.lower().endswith(suffix.lower()) and base.lower() != "license.txt":
            named[base.rsplit(".", 1)[0]] = info
    return named


class MemberReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.lines = int(options["lines"]) if options.get("lines") is not None else None
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.stems: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("stem",):
                these = set(f.value if isinstance(f, In) else [f.value])
                self.stems = these if self.stems is None else self.stems & these
            else:
                yield f

    def partitions(self):
        return [Range(path, lo, min(lo + self.split, size)) for path, size in archives_of(self.path) for lo in range(0, size, self.split)]

    def _content(self, z: zipfile.ZipFile, info: zipfile.ZipInfo) -> str | None:
        if self.lines == 0:
            return None
        with z.open(info) as f:
            data = f.read() if self.lines is None else b"".join(f.readline() for _ in range(self.lines))
        return data.decode("utf-8", "replace")

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, inner = _system(partition.path)
        rows, held = [], 0
        with system.open_input_file(inner) as raw, zipfile.ZipFile(raw) as z:
            for stem, info in sorted(wanted(z.infolist(), self.suffix).items(), key=lambda m: m[1].header_offset):
                if partition.lo <= info.header_offset < partition.hi and (self.stems is None or stem in self.stems):
                    content = self._content(z, info)
                    rows.append((partition.path, stem, content))
                    held += len(content or "")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=COLUMNS)


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "archive string, stem string, content string"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def members(spark: SparkSession, archives: str, suffix: str, lines: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """archive, stem, content of the members with this suffix (in any case). archives: a file, a folder or a pattern."""
    with_package(spark)
    spark.dataSource.register(ZipMembers)
    spark.conf.set(PUSHDOWN, "true")
    options = {"suffix": suffix, "splitBytes": split_bytes} | ({} if lines is None else {"lines": lines})
    return spark.read.format(FORMAT).options(**options).load(archives)


def count_members(spark: SparkSession, archives: str, suffix: str, expected: int | None = None) -> int:
    """How many members there are, from the directories alone; fails where another number is expected."""
    n = members(spark, archives, suffix, lines=0).count()
    if expected is not None and n != expected:
        raise ValueError(f"{expected} members expected in {archives}, {n} found")
    return n


def write_members(texts: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Each partition of texts (stem, content) as an archive below folder; (archive, n) of those written. A task that is run
    again replaces its archive; folder: one that all machines share. A null content is an empty member."""
    with_package(texts.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, inner = _system(folder)
        system.create_dir(inner, recursive=True)
        name = f"part-{context.partitionId():05d}.zip"
        attempt, n = f"{inner}/_{name}.{context.taskAttemptId()}", 0
        with system.open_output_stream(attempt) as raw, zipfile.ZipFile(io.BufferedWriter(raw), "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for stem, content in zip(*(c.to_pylist() for c in batch.columns)):
                    z.writestr(stem + suffix, content or "")
                    n += 1
        system.move(attempt, f"{inner}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["archive", "n"])

    return texts.select("stem", F.col("content").cast("string").alias("content")).mapInArrow(pack, "archive string, n long")
