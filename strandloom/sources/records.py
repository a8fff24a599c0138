"""Record formats cut by bytes: a data source whose partitions are byte ranges of files.

A partition owns the records that begin in its range, whole, so a file of any size is read by as many tasks as it has
ranges. Where a record begins is found from any byte on: by its mark at the start of a line, or, for four-line records
(whose quality lines may begin with any mark), by the only phase in which a line begins with ``@``, the second after it
with ``+``, and the lines between are as long as each other. What a file says before its first record is read once, when
the partitions are planned, and goes with each of them. Compressed files (.gz, .bz2) are one partition.

Files are opened through pyarrow's file systems (local or mounted paths, file:, s3:, gs:, hdfs:) by the tasks themselves.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, start bigint, head map<string,string>, lines array<string>"
SPLIT_BYTES = 32 << 20
#: Records and bytes of a batch that a task hands on.
BATCH_RECORDS, BATCH_BYTES = 10_000, 8 << 20
COMPRESSED = (".gz", ".bz2")
FOUR_LINES = "four-line"


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int
    head: dict[str, str]

    def __init__(self, file: str, begin: int, end: int, head: dict[str, str]) -> None:
        self.file, self.begin, self.end, self.head = file, begin, end, head


def _system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    local = re.match(r"file:/+(.*)", path)
    return (arrow_fs.LocalFileSystem(), f"/{local[1]}") if local else arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def _open(path: str, begin: int = 0) -> io.BufferedReader:
    system, at = _system(path)
    if at.endswith(COMPRESSED):
        return io.BufferedReader(system.open_input_stream(at), 1 << 16)
    raw = system.open_input_file(at)
    raw.seek(begin)
    return io.BufferedReader(raw, 1 << 16)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder without hidden ones."""
    system, at = _system(path)
    info = system.get_file_info(at)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = [info] if info.type == arrow_fs.FileType.File else system.get_file_info(arrow_fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(at) :].strip("/").split("/") if x)
    return sorted((prefix + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and (f.path == at or not hidden(f.path)))


def _head(path: str, mark: bytes) -> dict[str, str]:
    """The "@name value" lines before the first record."""
    out = {}
    with _open(path) as lines:
        for line in lines:
            if line.startswith(mark):
                break
            name = re.match(r"@(\S+)\s+(.*\S)", line.decode(errors="replace"))
            if name:
                out[name[1]] = name[2]
    return out


class _Lines:
    """The lines of a file from a byte on, each with where it begins; lines can be looked at before they are taken."""

    def __init__(self, source: io.BufferedReader, begin: int) -> None:
        self.source, self.at, self.ahead = source, begin, []
        if begin:  # the source stands at the byte before: what remains of its line belongs to the range before
            self.at += len(source.readline()) - 1

    def peek(self, i: int = 0) -> bytes:
        while len(self.ahead) <= i:
            self.ahead.append(self.source.readline())
        return self.ahead[i]

    def take(self) -> bytes:
        line = self.peek()
        del self.ahead[0]
        self.at += len(line)
        return line


def _text(line: bytes) -> str:
    return line.rstrip(b"\r\n").decode(errors="replace")


def _marked(lines: _Lines, end: int, mark: bytes) -> Iterator[tuple[int, list[str]]]:
    while lines.peek() and not lines.peek().startswith(mark):
        lines.take()
    while lines.peek() and lines.at < end:
        start, record = lines.at, [_text(lines.take())]
        while lines.peek() and not lines.peek().startswith(mark):
            record.append(_text(lines.take()))
        yield start, record


def _four(lines: _Lines, end: int, file: str) -> Iterator[tuple[int, list[str]]]:
    blank = lambda line: not line.strip()
    while lines.peek() and blank(lines.peek()):
        lines.take()

    def begins(i: int) -> bool:
        own = [_text(lines.peek(i + k)) for k in range(4)]
        return own[0].startswith("@") and own[2].startswith("+") and len(own[1]) == len(own[3])

    phase = next((i for i in range(4) if begins(i)), None)
    if phase is None:
        if not blank(lines.peek(3)) and lines.at < end:
            raise ValueError(f"{file}: no four-line record near byte {lines.at}")
        return
    for _ in range(phase):
        lines.take()
    while lines.peek() and lines.at < end:
        if blank(lines.peek()):
            lines.take()
            continue
        if not begins(0):
            raise ValueError(f"{file}: no four-line record at byte {lines.at}")
        start = lines.at
        yield start, [_text(lines.take()) for _ in range(4)]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.mark = options["path"], options.get("mark", ">")
        self.split, self.with_head = int(options.get("splitBytes", SPLIT_BYTES)), options.get("head", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        out = []
        for file, size in _files(self.path):
            head = _head(file, self.mark.encode()) if self.with_head else {}
            step = max(size, 1) if file.endswith(COMPRESSED) else self.split
            out += [Range(file, a, min(a + step, size) if not file.endswith(COMPRESSED) else 1 << 62, head) for a in range(0, size, step)]
        return out or [Range("", 0, 0, {})]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.begin:
            return
        columns: tuple[list, list] = ([], [])
        held = 0
        types = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()))

        def batch() -> pa.RecordBatch:
            n = len(columns[0])
            values = ([partition.file] * n, columns[0], [list(partition.head.items())] * n, columns[1])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["file", "start", "head", "lines"])

        with _open(partition.file, max(partition.begin - 1, 0)) as source:
            lines = _Lines(source, partition.begin)
            found = _four(lines, partition.end, partition.file) if self.mark == FOUR_LINES else _marked(lines, partition.end, self.mark.encode())
            for start, record in found:
                columns[0].append(start)
                columns[1].append(record)
                held += sum(map(len, record))
                if len(columns[0]) >= BATCH_RECORDS or held >= BATCH_BYTES:
                    yield batch()
                    columns, held = ([], []), 0
        if columns[0]:
            yield batch()


class RecordSource(DataSource):
    """Options: path; mark (what a record's first line begins with, or ``four-line``); head (true: "@name value" lines
    before the first record are wanted); splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "marked_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def records(spark: SparkSession, path: str, mark: str, head: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, start, head, lines): the records of a file or folder with the byte at which each begins in its file."""
    spark.dataSource.register(RecordSource)
    return spark.read.format(RecordSource.name()).option("mark", mark).option("head", str(head).lower()).option("splitBytes", str(split_bytes)).load(path)
