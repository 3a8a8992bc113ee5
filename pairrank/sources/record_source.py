"""Spark data sources ``sdf`` and ``fasta``: whole records of text files, by byte ranges.

    register_record_sources(spark)
    parse_sdf(spark.read.format("sdf").load(path), "record")
    spark.readStream.format("fasta").load(folder)

A file is cut into ranges of ``splitBytes``; a range yields the records that start in it, so
it looks for the first separator from a little before its own begin and reads on past its
end. A record's place is its byte offset, which says exactly which record is a file's
first, whatever the line ends and blank lines are. A ``.gz`` file is one range.

Rows are (file, changed, offset, record) in UTF-8, invalid bytes replaced. The path is a
file, a folder or a pattern over the names in a folder, on a filesystem that Arrow opens;
the readers of :mod:`pairrank.sources.readers` read any that Spark opens. A stream's offset
is the time and name of the last file taken, so each arriving file is read once; files
must be complete when they appear under their name.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, changed timestamp, offset bigint, record string"
SPLIT_BYTES = 64 << 20
#: Longer than any line that separates records.
BEFORE = 256


@dataclass
class Range(InputPartition):
    """The records of ``file`` that start in [start, end)."""

    file: str
    changed: float
    start: int
    end: int


def _files(path: str) -> list[tuple[str, float, int]]:
    """(uri, time of the last change, bytes) of the data files, by time and name."""
    prefix = path.split("://", 1)[0] + "://" if "://" in path else "file:" if path.startswith("file:") else ""
    folder, _, name = path.rstrip("/").rpartition("/")
    pattern = name if any(c in name for c in "*?[") else None
    system, inner = fs.FileSystem.from_uri(folder if pattern else path) if prefix else (fs.LocalFileSystem(), folder if pattern else path)
    found = system.get_file_info(inner)
    infos = [found] if found.is_file else system.get_file_info(fs.FileSelector(inner)) if found.type == fs.FileType.Directory else None
    if infos is None:
        raise FileNotFoundError(path)
    base = path if found.is_file else (folder if pattern else path).rstrip("/")
    kept = [i for i in infos if i.is_file and i.base_name[0] not in "._" and (pattern is None or fnmatch.fnmatch(i.base_name, pattern))]
    return sorted(((base if found.is_file else f"{base}/{i.base_name}", i.mtime.timestamp(), i.size) for i in kept), key=lambda f: (f[1], f[0]))


def _ranges(files: list[tuple[str, float, int]], size: int) -> list[Range]:
    out = []
    for file, changed, length in files:
        step = max(1, length) if file.endswith(".gz") else size
        out += [Range(file, changed, start, min(start + step, length)) for start in range(0, length, step)]
    return out


def _lines(file: str, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the whole lines from ``start`` on, a part of a line at the begin left out."""
    system, inner = fs.FileSystem.from_uri(file) if ":" in file.split("/", 1)[0] else (fs.LocalFileSystem(), file)
    with system.open_input_file(inner) as raw:
        stream = gzip.GzipFile(fileobj=raw) if file.endswith(".gz") else raw
        at = max(0, start)
        if at:
            stream.seek(at)
        buffered = io.BufferedReader(stream, 1 << 20)
        if at:
            at += len(buffered.readline())
        for line in buffered:
            yield at, line
            at += len(line)


def records(part: Range, fmt: str) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records that start in the range."""
    whole = part.file.endswith(".gz")
    held: list[bytes] = []
    begun = 0 if part.start == 0 and fmt == "sdf" else None
    for at, line in _lines(part.file, part.start - BEFORE):
        ends = fmt == "sdf" and line.startswith(b"$$$$")
        starts = fmt == "fasta" and line.startswith(b">")
        if starts and begun is not None:
            yield begun, b"".join(held)
            held = []
        if starts:
            begun = at if at >= part.start else None
        if begun is not None and not whole and begun >= part.end:
            return
        if ends:
            if begun is not None:
                yield begun, b"".join(held)
            held, begun = [], at + len(line) if at + len(line) >= part.start else None
            if begun is not None and not whole and begun >= part.end:
                return
        elif begun is not None:
            held.append(line)
    if begun is not None and held:
        yield begun, b"".join(held)


class _Reading:
    def __init__(self, fmt: str, options) -> None:
        self.fmt = fmt
        self.path = options["path"]
        self.size = int(options.get("splitBytes", SPLIT_BYTES))
        if self.size < 1:
            raise ValueError("splitBytes must be positive")

    def read(self, partition: Range) -> Iterator[tuple]:
        changed = datetime.fromtimestamp(partition.changed, timezone.utc)
        for offset, record in records(partition, self.fmt):
            if record.strip():
                yield partition.file, changed, offset, record.decode("utf-8", "replace")


class RecordReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        return _ranges(_files(self.path), self.size) or [Range("", 0.0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return super().read(partition) if partition.file else iter(())


class RecordStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": 0.0, "name": ""}

    def latestOffset(self) -> dict:
        found = _files(self.path)
        return {"time": found[-1][1], "name": found[-1][0]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = (start["time"], start["name"]), (end["time"], end["name"])
        return _ranges([f for f in _files(self.path) if low < (f[1], f[0]) <= high], self.size)


class SdfSource(DataSource):
    fmt = "sdf"

    @classmethod
    def name(cls) -> str:
        return cls.fmt

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.fmt, self.options)

    def streamReader(self, schema) -> RecordStream:
        return RecordStream(self.fmt, self.options)


class FastaSource(SdfSource):
    fmt = "fasta"


def register_record_sources(spark: SparkSession) -> None:
    for source in (SdfSource, FastaSource):
        spark.dataSource.register(source)
