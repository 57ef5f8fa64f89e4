"""A data source over ZIP archives that plans members, not archives: a task streams the members that it was given.

The planner reads the archives' directories at their ends, a few bytes for each member. Large members are a partition each, small ones
share one up to SHARE bytes. A task seeks to a member, unpacks it as a stream and hands over lines in batches, so neither an
archive nor a member has to fit into a task's memory; a document (``.md``, ``.json``) is one value and must. Archives
are read through ``pyarrow.fs`` (local files, HDFS and the object stores that it knows); ``packs.members`` reads the same rows through
Spark's own readers, an archive a task.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SHARE = 16 << 20  # unpacked bytes of small members in one partition
LINES, BYTES = 4096, 8 << 20  # of a batch
THREADS = 16  # that read directories
DOCUMENTS, RECORDS = (".md", ".json"), (".jsonl",)
_NAMES = ["path", "member", "line_no", "line"]


@dataclass
class Members(InputPartition):
    """Members of archives: (path, member) each."""

    members: list[tuple[str, str]]


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(where)


def _archives(path: str) -> list[str]:
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(where)] if path.endswith(where) else ""
    if system.get_file_info(where).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))


def _directory(path: str) -> list[tuple[str, str, int]]:
    """path, member and unpacked size of an archive's text members; nothing of what is no archive."""
    with _open(path) as file:
        try:
            return [(path, i.filename, i.file_size) for i in zipfile.ZipFile(file).infolist() if i.filename.endswith((*DOCUMENTS, *RECORDS))]
        except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter of a file that is shorter than an empty archive
            return []


def planned(members: list[tuple[str, str, int]], share: int = SHARE) -> list[Members]:
    """Partitions in the order of members; one that is as large as a share is alone."""
    out: list[Members] = []
    room = 0
    for path, member, size in members:
        if not out or size > room:
            out.append(Members([]))
            room = share
        out[-1].members.append((path, member))
        room -= size
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.share = options["path"], int(options.get("share", SHARE))

    def partitions(self) -> list[Members]:
        with ThreadPoolExecutor(THREADS) as pool:
            return planned([m for found in pool.map(_directory, _archives(self.path)) for m in found], self.share)

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        def batch(path: str, member: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([member] * len(rows)), pa.array([n for n, _ in rows], pa.int64()), pa.array([t for _, t in rows])], _NAMES)

        for path, member in partition.members:
            with _open(path) as file, zipfile.ZipFile(file).open(member) as stream:
                if member.endswith(DOCUMENTS):
                    yield batch(path, member, [(1, stream.read().decode("utf-8-sig", "replace"))])
                    continue
                rows: list[tuple[int, str]] = []
                held = 0
                for n, raw in enumerate(stream, 1):
                    rows.append((n, raw.decode("utf-8-sig" if n == 1 else "utf-8", "replace").rstrip("\r\n")))
                    held += len(raw)
                    if len(rows) == LINES or held >= BYTES:
                        yield batch(path, member, rows)
                        rows, held = [], 0
                if rows:
                    yield batch(path, member, rows)


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "path string, member string, line_no long, line string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(self.options)


def zip_members(spark: SparkSession, path: str, share: int = SHARE) -> DataFrame:
    """path, member, line_no and line of the text members of an archive or of all archives below a folder."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("share", share).load(path)
