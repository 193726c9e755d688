"""A batch data source for members of zip archives on any file system Arrow can open.

``spark.read.format("zip_members").option("prefixes", json).load(root)`` lists
(archive, member, content, index, file). An archive may be one file or a folder of parts, each a zip
file of its own: ``file`` is the part, and ``index`` the place in its sorted member list, whatever
is asked for. One partition is a range of a large file, or as many small files as make one. Filters on ``archive``, ``file`` and ``member``
(=, IN, starts with, ends with, contains) are pushed: a file that fails is not opened, a
member that fails the filters or the prefix rule is never inflated.
"""

from __future__ import annotations

import json
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains,
                                    StringEndsWith, StringStartsWith)

from ..functions import hashing
from .in_place import BATCH_BYTES, opened

RANGE_BYTES = 256 * 1024 * 1024
PACK_BYTES = 32 * 1024 * 1024       # files of one partition together, each counted with the cost of opening it
OPEN_BYTES = 1024 * 1024
SCHEMA = "archive string, member string, content binary, index bigint, file string"
NAMES = ("archive", "file", "member")

# What a pushed filter asks of a name.
TESTS = {
    EqualTo: lambda name, value: name == value,
    In: lambda name, value: name in value,
    StringStartsWith: lambda name, value: name.startswith(value),
    StringEndsWith: lambda name, value: name.endswith(value),
    StringContains: lambda name, value: value in name,
    IsNotNull: lambda name, value: True,
}


def _file_system(root: str):
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)


class MemberRange(InputPartition):
    """Slice ``part`` of ``parts`` of the sorted member list of a file that belongs to an archive."""

    def __init__(self, archive: str, part: int, parts: int, file: str | None = None):
        self.archive, self.part, self.parts, self.file = archive, part, parts, file or archive


class MemberRanges(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[MemberRange]):
        self.ranges = ranges


class ZipMembers(DataSource):
    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ZipMembersReader(self.options)


class ZipMembersReader(DataSourceReader):
    """``prefixes`` is JSON {archive: [prefix, ...]}; without it every file is an archive and read whole."""

    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.prefixes = json.loads(options["prefixes"]) if "prefixes" in options else None
        self.pushed = []

    def pushFilters(self, filters):
        """Keep the filters that names alone decide; Spark evaluates the others."""
        for condition in filters:
            column = condition.attribute[0] if hasattr(condition, "attribute") and len(condition.attribute) == 1 else None
            if type(condition) in TESTS and column in NAMES:
                self.pushed.append((column, type(condition), getattr(condition, "value", None)))
            else:
                yield condition

    def _passes(self, column: str, name: str) -> bool:
        return all(TESTS[kind](name, value) for asked, kind, value in self.pushed if asked == column)

    def partitions(self):
        system, base = _file_system(self.root)
        base = base.rstrip("/")
        zips = lambda folder: [info for info in system.get_file_info(fs.FileSelector(folder, recursive=True))
                               if info.path.endswith(".zip") and info.type == fs.FileType.File
                               and not info.path.rsplit("/", 1)[-1].startswith(("_", "."))]
        if self.prefixes is None:
            found = [(info.path[len(base) + 1:], info) for info in zips(base)]
        else:
            wanted = [name for name in self.prefixes if self._passes("archive", name)]
            found = []
            for name, info in zip(wanted, system.get_file_info([f"{base}/{name}" for name in wanted])):
                if info.type == fs.FileType.NotFound:
                    raise FileNotFoundError(info.path)
                found += [(name, part) for part in ([info] if info.type == fs.FileType.File else zips(info.path))]
        packed, room = [], 0
        for archive, info in sorted(found, key=lambda pair: (pair[0], pair[1].path)):
            file = info.path[len(base) + 1:]
            if self._passes("archive", archive) and self._passes("file", file):
                parts = max(1, -(-info.size // RANGE_BYTES))
                for part in range(parts):
                    cost = info.size // parts + OPEN_BYTES
                    if cost > room:
                        packed.append([])
                        room = PACK_BYTES
                    packed[-1].append(MemberRange(archive, part, parts, file))
                    room -= cost
        return [MemberRanges(ranges) for ranges in packed]

    def members(self, partition, names: list[str]) -> list[tuple[int, str]]:
        """(place, name) of the wanted members of a range."""
        wanted = None if self.prefixes is None else tuple(self.prefixes[partition.archive])
        members = [(i, name) for i, name in enumerate(sorted(names))
                   if not name.endswith("/") and not name.startswith("__MACOSX/")
                   and (wanted is None or name.startswith(wanted)) and self._passes("member", name)]
        start = len(members) * partition.part // partition.parts
        return members[start:len(members) * (partition.part + 1) // partition.parts]

    def read(self, partition):
        """Arrow batches of about ``BATCH_BYTES``; a larger member goes alone."""
        for each in partition.ranges if partition else ():       # None: no file is left
            yield from self.batches(each)

    def batches(self, partition):
        with opened(f"{self.root}/{partition.file}") as handle, zipfile.ZipFile(handle) as archive:
            rows, size = [], 0
            for i, name in self.members(partition, archive.namelist()):
                length = archive.getinfo(name).file_size
                if rows and size + length > BATCH_BYTES:
                    yield self._batch(partition, rows)
                    rows, size = [], 0
                rows.append((name, archive.read(name), i))
                size += length
            if rows:
                yield self._batch(partition, rows)

    @staticmethod
    def _batch(partition, rows) -> pa.RecordBatch:
        names, contents, places = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([partition.archive] * len(rows), pa.string()), pa.array(names, pa.string()), pa.array(contents, pa.binary()),
             pa.array(places, pa.int64()), pa.array([partition.file] * len(rows), pa.string())],
            names=["archive", "member", "content", "index", "file"])


def register(spark) -> None:
    """Register the source and let Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)


def read_archives(spark, root: str, registry_rows, dataset: str):
    """Members of one dataset's archives as raw rows ready for registry mapping.

    ``registry_rows`` is the list from :func:`mediasieve.registry.source_rows`. A filter on
    ``archive``, ``file`` or ``member`` of the result is pushed into the archives.
    """
    prefixes: dict[str, list[str]] = {}
    for row in registry_rows:
        if row[0] == dataset and row[6] is not None:
            prefixes.setdefault(row[6], []).append(row[7])
    return read_members(spark, root, prefixes).select(
        F.lit(dataset).alias("dataset"), "archive", "member", F.lit(None).cast("int").alias("upstream_label"),
        F.lit("").alias("upstream_split"), "file", F.col("index").alias("row"),
        F.concat("archive", F.lit(":"), "member").alias("raw_id"), hashing.sha(F.col("content")).alias("raw_sha256"), "content")


def read_members(spark, root: str, prefixes: dict[str, list[str]]):
    """Members that start with an archive's prefixes, in the columns of the source."""
    register(spark)
    return spark.read.format("zip_members").option("prefixes", json.dumps(prefixes)).load(root)


def write_archives(members, root: str):
    """Write (file, member, content) rows as the zip files they name; lists files and members.

    The rows of a file meet in one task, sorted by member, and stream into it, so a file should
    hold a bounded number of them. It is written under another name and moved in place when
    it is whole: a task that runs again leaves the same file.
    """
    def run(batches):
        system, base = _file_system(root.rstrip("/"))
        current, handle, archive, written = None, None, None, []

        def close():
            if current is not None:
                archive.close()
                handle.close()
                system.move(_unfinished(current), f"{base}/{current}")

        def _unfinished(file):
            folder, _, name = f"{base}/{file}".rpartition("/")
            return f"{folder}/_{attempt}_{name}"

        attempt = uuid.uuid4().hex
        for batch in batches:
            for file, member, content in zip(*[batch.column(name).to_pylist() for name in ("file", "member", "content")]):
                if file != current:
                    close()
                    current = file
                    system.create_dir(f"{base}/{file}".rpartition("/")[0], recursive=True)
                    handle = system.open_output_stream(_unfinished(file))
                    archive = zipfile.ZipFile(handle, "w", zipfile.ZIP_DEFLATED)
                    written.append([file, 0])
                archive.writestr(member, content)
                written[-1][1] += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in written], pa.string()), pa.array([n for _, n in written], pa.int64())],
                                         names=["file", "members"])

    rows = members.select("file", "member", "content").repartition("file").sortWithinPartitions("file", "member")
    return rows.mapInArrow(run, "file string, members bigint")


def write_files(files, root: str):
    """Write (path, content) rows as files below a folder; lists path and size."""
    def run(batches):
        system, base = _file_system(root.rstrip("/"))
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as target:
                    target.write(content)
            yield batch[["path"]].assign(size=batch["content"].str.len())

    return files.mapInPandas(run, "path string, size bigint")
