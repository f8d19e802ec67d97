"""Zip archives as a Spark data source, in batch and as a stream: format("archive_lines").

A partition is one member, whose lines are read as the member is unpacked, in batches of bounded size: neither an archive nor
a member is ever held whole, and members of one large archive are read by as many tasks. Paths are those that Arrow's
file systems open, local or of an object store.

    spark.dataSource.register(ArchiveLines)
    spark.read.format("archive_lines").option("glob", "*.txt").load("/folder")
"""

from __future__ import annotations

import codecs
import fnmatch
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "archive string, member string, line_no bigint, line string, problem string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("problem", pa.string())])
#: Bytes read from a member at once, and lines of a batch.
CHUNK, BATCH = 1 << 20, 10_000


@dataclass
class Member(InputPartition):
    """A member of an archive; an archive that can't be read is a partition without a member, with its problem."""

    path: str
    archive: str
    member: str | None
    problem: str | None = None


def _lines(data: IO[bytes]) -> Iterator[str]:
    """Lines without their ends (\\n or \\r\\n); what isn't UTF-8 is replaced."""
    decode, rest = codecs.getincrementaldecoder("utf-8-sig")("replace"), []
    while True:
        chunk = data.read(CHUNK)
        first, *more = decode.decode(chunk, final=not chunk).split("\n")
        rest.append(first)
        for line in more:
            yield "".join(rest).removesuffix("\r")
            rest = [line]
        if not chunk:
            break
    if last := "".join(rest):
        yield last.removesuffix("\r")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Reader:
    """What batch and stream share."""

    def __init__(self, options: dict) -> None:
        self.path, self.glob, self.archives = options.get("path", ""), options.get("glob", "*"), options.get("archives", "*.zip")

    def _found(self) -> list[tuple[int, str]]:
        """(time, path) of the archives under the folder, oldest first."""
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        files = [i for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.archives)]
        return sorted((i.mtime_ns or 0, i.path) for i in files)

    def _members(self, paths: list[str]) -> list[Member]:
        """A member's turn is that in its archive; folders and members that the glob leaves out have none."""
        out = []
        for path in paths:
            name = path.rpartition("/")[2]
            try:
                with self._system().open_input_file(path) as data, zipfile.ZipFile(data) as archive:
                    out += [Member(path, name, i.filename) for i in archive.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename, self.glob)]
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                out.append(Member(path, name, None, f"{type(e).__name__}: {e}"))
        return out

    def _system(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        name, member = partition.archive, partition.member
        if member is None:
            yield _batch([(name, None, None, None, partition.problem)])
            return
        rows: list[tuple] = []
        at = 0
        try:
            with self._system().open_input_file(partition.path) as data, zipfile.ZipFile(data) as archive, archive.open(member) as body:
                for line in _lines(body):
                    rows.append((name, member, at, line, None))
                    at += 1
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
            rows.append((name, member, at, None, f"{type(e).__name__}: {e}"))
        if rows:
            yield _batch(rows)


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Member]:
        return self._members([path for _, path in self._found()])


class StreamReader(_Reader, DataSourceStreamReader):
    """New archives are those after the last one by (time of writing, path); an archive is written elsewhere and moved in."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self._found()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Member]:
        lo, hi = (start["time"], start["path"]), (end["time"], end["path"])
        return self._members([path for time, path in self._found() if lo < (time, path) <= hi])


class ArchiveLines(DataSource):
    """archive, member, line_no (from 0), line and problem of the zip archives (option archives, *.zip) under a path, of members that the option glob matches.

    An empty member has no rows. What can't be read is one row with its problem, after the lines that could.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str | StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self.options)
