"""Growing logs of lines as a Spark data source (format `line_log`): batch, stream and an append sink.

A reader deals the files of a folder into byte ranges; a line belongs to the range that it starts in, so every line is read
once however the ranges fall. A stream's offset says how many bytes of every file have been read, always up to the end of a
line: what follows the last line end is an unfinished line and waits for the next micro-batch. Lines are bytes up to a
line feed, decoded as UTF-8 with replacement; a batch read takes an unfinished last line as well.

The sink writes a task's rows to a draft beside the log and a committed batch renames them by its number, so a batch that
is run again after a failure replaces its own files and no line comes twice. Readers see files by the suffix `.log` only.

Paths are those that pyarrow's file systems open (local, hdfs, s3, gcs). Parsing lines is left to Spark:
`tables.event_lines`.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a range, and of what is read at a time.
RANGE, READ = 64 << 20, 1 << 20
SUFFIX = ".log"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def _sizes(path: str) -> dict[str, int]:
    """Name and size of the log files of a folder."""
    fs, folder = _store(path)
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith(SUFFIX)}


def _whole(path: str, name: str, begin: int, size: int) -> int:
    """The end of the last finished line of a file, `begin` if no line has ended since."""
    fs, folder = _store(path)
    with fs.open_input_file(f"{folder}/{name}") as f:
        end = size
        while end > begin:
            start = max(begin, end - READ)
            f.seek(start)
            if (at := f.read(end - start).rfind(b"\n")) >= 0:
                return start + at + 1
            end = start
    return begin


@dataclass
class Range(InputPartition):
    """Bytes of a file; `opens` says that a line starts at the first."""

    name: str
    begin: int
    end: int
    stop: int
    opens: bool


def _ranges(name: str, begin: int, stop: int) -> list[Range]:
    return [Range(name, at, min(at + RANGE, stop), stop, at == begin) for at in range(begin, stop, RANGE)]


def _lines(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in a range."""
    fs, folder = _store(path)
    with fs.open_input_file(f"{folder}/{part.name}") as f:
        # a line that starts at the range's first byte is known by the line end before it
        at = part.begin if part.opens else part.begin - 1
        f.seek(at)
        held, skip = b"", not part.opens
        while True:
            data = f.read(min(READ, part.stop - at - len(held)))
            *ended, held = (held + data).split(b"\n")
            for line in ended:
                if not skip:
                    yield at, line
                skip = False
                at += len(line) + 1
                if at >= part.end:
                    return
            if not data:
                if held and not skip:
                    yield at, held
                return


def _batches(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    offsets, lines, size = [], [], 0
    for at, line in _lines(path, part):
        offsets.append(at)
        lines.append(line.decode("utf-8", "replace"))
        size += len(line)
        if size >= READ:
            yield _batch(part.name, offsets, lines)
            offsets, lines, size = [], [], 0
    if lines:
        yield _batch(part.name, offsets, lines)


def _batch(name: str, offsets: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "value"])


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        return [r for name, size in sorted(_sizes(self.path).items()) for r in _ranges(name, 0, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.seen = path, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for name, size in _sizes(self.path).items():
            # what was whole stays so: only new bytes are searched for a line's end
            self.seen[name] = _whole(self.path, name, self.seen.get(name, 0), size)
        return dict(sorted(self.seen.items()))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for name, stop in end.items() if stop > start.get(name, 0) for r in _ranges(name, start.get(name, 0), stop)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition)


@dataclass
class Draft(WriterCommitMessage):
    name: str | None


class _Sink:
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> Draft:
        fs, folder = _store(self.path)
        name = f"draft-{uuid.uuid4().hex}"
        lines = (row["value"] for row in rows)
        first = next(lines, None)
        if first is None:
            return Draft(None)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for line in itertools.chain([first], lines):
                out.write(f"{line}\n".encode())
        return Draft(name)

    def _abort(self, messages: list) -> None:
        fs, folder = _store(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{folder}/{m.name}")

    def _publish(self, messages: list, prefix: str) -> None:
        """Gives the drafts their names; names of an earlier try of the same batch that are left over go."""
        fs, folder = _store(self.path)
        old = {name for name in _sizes(self.path) if name.startswith(prefix)}
        for i, m in enumerate(m for m in messages if m is not None and m.name):
            fs.move(f"{folder}/{m.name}", f"{folder}/{prefix}{i:05d}{SUFFIX}")
            old.discard(f"{prefix}{i:05d}{SUFFIX}")
        for name in old:
            fs.delete_file(f"{folder}/{name}")


class LogWriter(_Sink, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._publish(messages, f"{uuid.uuid4().hex}-")

    def abort(self, messages: list) -> None:
        self._abort(messages)


class LogStreamWriter(_Sink, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._publish(messages, f"batch-{batchId:012d}-")

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


class LineLog(DataSource):
    """file, at (the offset of the line's first byte) and value; the sink takes value."""

    @classmethod
    def name(cls) -> str:
        return "line_log"

    def schema(self) -> str:
        return "file string, at long, value string"

    def _path(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError("line_log needs a path")
        return path

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self._path())

    def streamReader(self, schema: StructType) -> LogStreamReader:
        return LogStreamReader(self._path())

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log can only be appended to")
        return LogWriter(self._path())

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self._path())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineLog)
