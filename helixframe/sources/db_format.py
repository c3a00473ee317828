"""Keyed databases of plain files as a Spark format, "keyed_db", to read and to write.

A database is path (the entries' bytes), path.index (key, offset, length), path.lookup
(key, name, file number) and path.dbtype. It is read by ranges of the index's bytes,
of which each task finds its own lines and names; no task and not the driver holds the
index. It is written in two phases: tasks write their rows at known places of hidden
files, and the commit gives these their names, or the abort removes them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .shared import local_path

FORMAT = "keyed_db"
READ = "key long, name string, content binary"
#: What is written: a part of one of the files and where it belongs.
WRITE = "file string, offset long, content binary"
FILES = ("", ".index", ".lookup", ".dbtype")
#: Bytes of the index that one task reads, unless an option says otherwise, and of contents in one Arrow batch.
SPLIT, BATCH = 4 << 20, 8 << 20


def _line_start(file, at: int) -> int:
    """Where the first line begins that starts at a place or behind it."""
    if at <= 0:
        return 0
    file.seek(at - 1)
    file.readline()
    return file.tell()


def _first_at_least(file, size: int, key: int) -> int:
    """Where the first line begins whose key is at least so much, of lines in order of key."""
    low, high = 0, size
    while low < high:
        middle = (low + high) // 2
        start = _line_start(file, middle)
        line = file.readline()
        if line and int(line.split(b"\t", 1)[0]) < key:
            low = start + len(line)
        else:
            high = middle
    return _line_start(file, low)


@dataclass
class Range(InputPartition):
    """Bytes of the index; lines that begin there are the task's."""

    start: int
    end: int


class Reader(DataSourceReader):
    """Entries by ranges of the index; keys and names asked for keep other contents from being read, and keys whole ranges."""

    def __init__(self, path: str, split: int, keys: list[int] | None, names: list[str] | None, strict: bool) -> None:
        self.path, self.split, self.strict = path, split, strict
        self.keys = set(keys) if keys is not None else None
        self.names = set(names) if names is not None else None
        self.low, self.high = None, None

    def _span(self) -> tuple[int, int]:
        """Bytes of the index that may have lines asked for."""
        size = os.path.getsize(f"{self.path}.index")
        bounds = [(min(self.keys), max(self.keys) + 1)] if self.keys else []
        low = max([b[0] for b in bounds] + ([self.low] if self.low is not None else []), default=None)
        high = min([b[1] for b in bounds] + ([self.high] if self.high is not None else []), default=None)
        with open(f"{self.path}.index", "rb") as index:
            start = 0 if low is None else _first_at_least(index, size, low)
            end = size if high is None else _first_at_least(index, size, high)
            if self.strict and self.keys is not None:
                lost = [k for k in sorted(self.keys) if (at := _first_at_least(index, size, k)) >= size or not _has_key(index, at, k)]
                if lost:
                    raise KeyError(", ".join(map(str, lost[:5])))
        return start, max(start, end)

    def partitions(self) -> list[Range]:
        if (self.keys is not None and not self.keys) or (self.names is not None and not self.names):
            return [Range(0, 0)]
        start, end = self._span()
        return [Range(at, min(at + self.split, end)) for at in range(start, end, self.split)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("name", pa.string()), ("content", pa.binary())])
        keys, names, contents, held = [], [], [], 0
        for key, name, offset, length in self._entries(partition):
            self._data.seek(offset)
            content = self._data.read(length)
            if len(content) < length:
                raise OSError(f"{self.path}: entry {key} ends behind the file")
            keys.append(key)
            names.append(name)
            contents.append(content)
            held += length
            if held >= BATCH or len(keys) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=schema)
                keys, names, contents, held = [], [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=schema)

    def _entries(self, partition: Range) -> Iterator[tuple[int, str, int, int]]:
        """key, name, offset and length of the lines asked for that begin in a range. Index and lookup are walked side by side, in order of key."""
        if partition.start >= partition.end:
            return
        with open(self.path, "rb") as self._data, open(f"{self.path}.index", "rb") as index, open(f"{self.path}.lookup", "rb") as lookup:
            size, at, before = os.path.getsize(f"{self.path}.lookup"), _line_start(index, partition.start), None
            index.seek(at)
            named = None
            while at < partition.end:
                line = index.readline()
                if not line:
                    return
                at += len(line)
                key, offset, length = map(int, line.split(b"\t")[:3])
                if before is not None and key < before:
                    raise ValueError(f"{self.path}.index is not in order of key; read_native takes any order")
                before = key
                if named is None:
                    lookup.seek(_first_at_least(lookup, size, key))
                    named = self._name(lookup)
                while named[0] is not None and named[0] < key:
                    named = self._name(lookup)
                name = named[1] if named[0] == key else ""
                if (self.keys is None or key in self.keys) and (self.names is None or name in self.names) and (self.low is None or key >= self.low) and (self.high is None or key < self.high):
                    yield key, name, offset, length

    @staticmethod
    def _name(lookup) -> tuple[int | None, str]:
        line = lookup.readline()
        if not line:
            return None, ""
        key, name, *_ = line.rstrip(b"\n").split(b"\t")
        return int(key), name.decode()


class PushedReader(Reader):
    """A Reader that takes filters; Spark refuses one where its pushdown into Python formats is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column == "key" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = wanted if self.keys is None else self.keys & wanted
            elif column == "name" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            elif column == "key" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low or 0, f.value + isinstance(f, GreaterThan))
            elif column == "key" and isinstance(f, (LessThan, LessThanOrEqual)):
                end = f.value + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            else:
                yield f


def _has_key(index, at: int, key: int) -> bool:
    index.seek(at)
    return int(index.readline().split(b"\t", 1)[0]) == key


@dataclass
class Written(WriterCommitMessage):
    sizes: dict[str, int]


class Writer(DataSourceArrowWriter):
    """Writes parts where they belong in hidden files; these get their names when all tasks are done."""

    def __init__(self, path: str, sizes: dict[str, int], overwrite: bool) -> None:
        self.path, self.sizes = path, sizes
        if not overwrite and any(os.path.exists(path + f) for f in FILES):
            raise FileExistsError(path)
        folder, base = os.path.split(path)
        self.hidden = os.path.join(folder, f".{base}.{uuid.uuid4().hex}")
        for f in FILES:
            with open(self.hidden + f, "wb") as out:
                out.truncate(sizes.get(f, 0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = {f: os.open(self.hidden + f, os.O_WRONLY) for f in FILES}
        sizes = dict.fromkeys(FILES, 0)
        try:
            for batch in iterator:
                for file, offset, content in zip(*(batch.column(n) for n in ("file", "offset", "content")), strict=True):
                    name, at, left = file.as_py(), offset.as_py(), memoryview(content.as_buffer() or b"")
                    sizes[name] += len(left)
                    while left:
                        n = os.pwrite(files[name], left, at)
                        left, at = left[n:], at + n
            for f in files.values():
                os.fsync(f)
        finally:
            for f in files.values():
                os.close(f)
        return Written(sizes)

    def commit(self, messages: list[Written | None]) -> None:
        for f in FILES:
            written = sum(m.sizes[f] for m in messages if m)
            if written != self.sizes.get(f, 0):
                self.abort(messages)
                raise OSError(f"{self.path}{f}: {written} bytes for a file of {self.sizes.get(f, 0)}")
        # The type comes last: a database is one once it is there.
        for f in FILES:
            os.replace(self.hidden + f, self.path + f)

    def abort(self, messages: list[Written | None]) -> None:
        for f in FILES:
            if os.path.exists(self.hidden + f):
                os.remove(self.hidden + f)


class KeyedDb(DataSource):
    """Options: path; to read: keys or names (lists as JSON), strict, split (bytes of index a task), pushdown (of filters); to write: sizes (of the files, as JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def _path(self) -> str:
        return local_path(self.options["path"])

    def reader(self, schema: StructType) -> Reader:
        listed = {n: json.loads(self.options[n]) if n in self.options else None for n in ("keys", "names")}
        kind = PushedReader if self.options.get("pushdown", "false").lower() == "true" else Reader
        return kind(self._path(), int(self.options.get("split", SPLIT)), listed["keys"], listed["names"], self.options.get("strict", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self._path(), json.loads(self.options["sizes"]), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeyedDb)


def load(spark: SparkSession, path: str, keys: list[int] | None = None, names: list[str] | None = None, strict: bool = False, split: int = SPLIT) -> DataFrame:
    """key, name and content of a database, of keys or names where they are given; strict: those that it lacks are an error.

    The lists travel to every task, so they are for as many ids as a user writes down;
    read_native joins those of a table. Filters on key and name are pushed down where
    spark.sql.python.filterPushdown.enabled is set.
    """
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(FORMAT).option("split", split).option("pushdown", pushdown).option("strict", str(strict).lower())
    if strict and names is not None:
        found = {r["name"] for r in reader.option("names", json.dumps(names)).load(path).select("name").distinct().collect()}
        if lost := [n for n in names if n not in found]:
            raise KeyError(", ".join(lost[:5]))
    for option, values in (("keys", keys), ("names", names)):
        if values is not None:
            reader = reader.option(option, json.dumps(values))
    return reader.load(path)


def save(parts: DataFrame, sizes: dict[str, int], path: str, overwrite: bool = False) -> None:
    """Writes parts (file, offset, content) of a database's files of known sizes in two phases."""
    register(parts.sparkSession)
    held = parts.select("file", F.col("offset").cast("long").alias("offset"), F.col("content").cast("binary").alias("content"))
    held.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("sizes", json.dumps(sizes)).save(path)
