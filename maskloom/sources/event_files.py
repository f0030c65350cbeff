"""A data source of files of server-sent events: spark.read, readStream, write and writeStream with format("sse").

A file is read in byte ranges. An event is a run of lines without an empty one, and belongs to the range that its first
byte is in, so any size of ranges gives the same rows. What a job writes counts once its manifest is there: files of
failed or repeated tasks are never read, and a batch of a stream that is written again changes nothing.
"""

from __future__ import annotations

import codecs
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

SCHEMA = "file string, at bigint, event string, id string, retry bigint, data string"
#: Bytes of a range, rows and characters of data of a batch, bytes that are read at a time to find a file's last border.
SPLIT_BYTES, BATCH_ROWS, BATCH_CHARS, BLOCK = 64 << 20, 4096, 8 << 20, 1 << 16
MANIFESTS = "_committed"
_ARROW = pa.schema([(n, pa.int64() if n in ("at", "retry") else pa.string()) for n in ("file", "at", "event", "id", "retry", "data")])


@dataclass
class Range(InputPartition):
    """Events of a file that begin in [start, end)."""

    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str | None


def _blank(line: bytes) -> bool:
    return line in (b"\n", b"\r\n")


def raw_events(file: io.BufferedIOBase, start: int, end: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first byte, lines) of the events that begin in [start, end)."""
    at = max(0, start - 3)  # an empty line before start has three bytes at most with the end of the line before
    file.seek(at)
    empty_before, lines, first = at == 0, [], 0
    for line in file:
        if _blank(line):
            if lines:
                yield first, lines
                lines = []
            empty_before = True
        elif lines:
            lines.append(line)
        elif empty_before and at >= start:
            if at >= end:
                return
            first, lines, empty_before = at, [line], False
        else:
            empty_before = False
        at += len(line)
        if at >= end and not lines and not empty_before:
            return
    if lines:
        yield first, lines


def fields_of(lines: list[bytes]) -> tuple[str | None, str | None, int | None, str]:
    """event, id, retry and data of an event's lines; the first of several names counts, data lines are joined. What is
    no UTF-8 becomes U+FFFD."""
    named: dict[str, str] = {}
    data: list[str] = []
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r").partition(":")
        value = value.removeprefix(" ")
        if name == "data" and colon:
            data.append(value)
        else:
            named.setdefault(name, value)
    retry = named.get("retry", "")
    return named.get("event"), named.get("id"), int(retry) if re.fullmatch("[0-9]{1,18}", retry) else None, "\n".join(data)


def event_of(event: str | None, event_id: str | None, retry: float | None, data: str | None) -> str:
    """An event as it is written: names on one line, data line by line, a retry of at least 0."""
    one_line = lambda s: re.sub(r"[\r\n]", "", s)
    lines = [f"event: {one_line(event)}"] if event is not None else []
    lines += [f"id: {one_line(event_id)}"] if event_id is not None else []
    lines += [f"retry: {max(0, int(retry))}"] if retry is not None and retry == retry and abs(retry) < 1e18 else []
    return "\n".join([*lines, *(f"data: {x}" for x in re.split(r"\r\n|\r|\n", data or ""))]) + "\n\n"


def _open(path: str) -> io.BufferedReader:
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)
    return io.BufferedReader(where.open_input_file(name), 1 << 20)


class _Folder:
    """A file, or the files below a folder that are no hidden ones. A folder that jobs have written has manifests; then
    only the files that they name count."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.name = fs.FileSystem.from_uri(path)
        self.prefix = path[: len(path) - len(self.name)] if path.endswith(self.name) else ""

    def sizes(self) -> dict[str, int]:
        """Paths and sizes, by path."""
        info = self.fs.get_file_info(self.name)
        if info.type == fs.FileType.File:
            return {self.path: info.size}
        found = self.fs.get_file_info(fs.FileSelector(self.name, allow_not_found=False, recursive=True))
        inner = lambda i: i.path[len(self.name.rstrip("/")) + 1 :]
        files = {inner(i): i for i in found if i.type == fs.FileType.File}
        named = self._named([n for n in files if n.startswith(f"{MANIFESTS}/") and n.endswith(".json")])
        rows = {n: i for n, i in files.items() if not any(p.startswith(("_", ".")) for p in n.split("/")) and (named is None or n in named)}
        return {self.prefix + i.path: i.size for _, i in sorted(rows.items())}

    def _named(self, manifests: list[str]) -> set[str] | None:
        names: set[str] = set()
        for m in manifests:
            with self.fs.open_input_file(f"{self.name}/{m}") as f:
                names |= set(json.loads(f.read()))
        return names if manifests else None

    def manifest(self, key: str) -> str:
        return f"{self.name}/{MANIFESTS}/{key}.json"

    def commit(self, key: str, names: list[str]) -> None:
        """names count from now on. If key's manifest is there already they are deleted instead."""
        if self.fs.get_file_info(self.manifest(key)).type == fs.FileType.File:
            return self.delete(names)
        self.fs.create_dir(f"{self.name}/{MANIFESTS}", recursive=True)
        begun = f"{self.name}/{MANIFESTS}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(begun) as f:
            f.write(json.dumps(sorted(names)).encode())
        self.fs.move(begun, self.manifest(key))

    def delete(self, names: list[str]) -> None:
        for n in names:
            if self.fs.get_file_info(f"{self.name}/{n}").type == fs.FileType.File:
                self.fs.delete_file(f"{self.name}/{n}")

    def clear(self) -> None:
        if self.fs.get_file_info(self.name).type == fs.FileType.Directory:
            self.fs.delete_dir_contents(self.name)


def _ranges(file: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(file, k, min(k + split, end)) for k in range(start, end, split)]


def _batches(part: Range) -> Iterator[pa.RecordBatch]:
    rows, chars = [], 0
    with _open(part.file) as file:
        for at, lines in raw_events(file, part.start, part.end):
            if at == 0:
                lines[0] = lines[0].removeprefix(codecs.BOM_UTF8)
            event, event_id, retry, data = fields_of(lines)
            rows.append((part.file, at, event, event_id, retry, data))
            chars += len(data)
            if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield _batch(rows)
                rows, chars = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class _Reader(DataSourceReader):
    """All files, a task for each range; what begins after the last empty line of a file is an event too."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return [r for file, size in _Folder(self.path).sizes().items() for r in _ranges(file, 0, size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if partition.file else iter(())


def last_border(file: io.BufferedIOBase, start: int, end: int) -> int:
    """The end of the last empty line in [start, end), or start: what begins behind it may still grow."""
    at, later = end, b""
    while at > start:
        size = min(BLOCK, at - start)
        at -= size
        file.seek(at)
        piece = file.read(size)
        m = list(re.finditer(rb"\n\r?\n", piece + later))
        if m:
            return at + m[-1].end()
        later = piece[:2]  # a border may be cut by the block's end
    return start


class _StreamReader(DataSourceStreamReader):
    """Files that grow, or come anew. An offset has for each file the end of its last whole event, so it grows with the
    number of files: the source is for logs that are appended to, and Spark's text source for many small finished files.
    A file that gets shorter is an error."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.seen: dict[str, int] = {}
        self.borders: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        for file, size in _Folder(self.path).sizes().items():
            if size < self.seen.get(file, 0):
                raise ValueError(f"{file} has become shorter")
            if size > self.seen.get(file, -1):
                with _open(file) as f:
                    self.borders[file] = last_border(f, self.borders.get(file, 0), size)
                self.seen[file] = size
        return {"files": dict(sorted(self.borders.items()))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        done = start["files"]
        return [r for file, to in end["files"].items() for r in _ranges(file, done.get(file, 0), to, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition)

    def commit(self, end: dict) -> None:
        pass


class _Output:
    """A task writes one file under a new name, and none if it has no row."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, out, name = _Folder(self.path), None, f"part-{uuid.uuid4().hex}.sse"
        for batch in iterator:
            if out is None and batch.num_rows:
                folder.fs.create_dir(folder.name, recursive=True)
                out = folder.fs.open_output_stream(f"{folder.name}/{name}")
            columns = [batch.column(n).to_pylist() if n in batch.schema.names else [None] * batch.num_rows for n in ("event", "id", "retry", "data")]
            if batch.num_rows:
                out.write("".join(event_of(*row) for row in zip(*columns, strict=True)).encode("utf-8", "replace"))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def names(self, messages: list[Written | None]) -> list[str]:
        return [m.name for m in messages if m is not None and m.name]


class _Writer(_Output, DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        super().__init__(path)
        if overwrite:
            _Folder(path).clear()

    def commit(self, messages: list[Written | None]) -> None:
        _Folder(self.path).commit(f"job-{uuid.uuid4().hex}", self.names(messages))

    def abort(self, messages: list[Written | None]) -> None:
        _Folder(self.path).delete(self.names(messages))


class _StreamWriter(_Output, DataSourceStreamArrowWriter):
    """query: the option of that name, as two queries into one folder have batches of the same numbers."""

    def __init__(self, path: str, query: str):
        super().__init__(path)
        self.query = query

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        _Folder(self.path).commit(f"{self.query}-{batchId}", self.names(messages))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        _Folder(self.path).delete(self.names(messages))


class EventFiles(DataSource):
    """format("sse"). Options: path (a file or folder, with a scheme or absolute), splitBytes, query.

    Read are file, at (the event's first byte), event, id, retry and data. Written are event, id, retry and data, as far as
    the table has them; further columns are not, so rows that were read can be written again. Null data is one empty line.
    """

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("format sse needs a path")
        return self.options["path"]

    def _split(self) -> int:
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        if split < 1:
            raise ValueError("splitBytes has to be at least 1")
        return split

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._path(), self._split())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self._path(), self._split())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._path(), overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self._path(), self.options.get("query", "batch"))


def register(spark: SparkSession) -> None:
    """Make format("sse") known to a session."""
    spark.dataSource.register(EventFiles)
