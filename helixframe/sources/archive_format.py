"""Members of tar archives as a Spark format, "tar_members".

An archive is cut into ranges of whole members, which tasks read on their own; nothing
holds an archive, whatever its size. Where members begin is found by tasks too, each
from the first header in its bytes on; the driver links what they found. A compressed
archive is one stream, read by one task.
"""

from __future__ import annotations

import json
import os
import re
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .shared import local_path

FORMAT = "tar_members"
READ = "path string, entry string, name string, content binary"
#: Bytes of an archive that one task reads, unless an option says otherwise, and of contents in one Arrow batch.
SPLIT, BATCH = 64 << 20, 8 << 20
#: Ranges of one archive at most; where the bytes asked for make more, ranges are wider. Headers that a range tells, so that others are linked to it.
RANGES, TOLD = 1000, 16
ARCHIVE = re.compile(r"\.(tar|tar\.gz|tgz)$")
BROKEN = (OSError, EOFError, tarfile.TarError, zlib.error)


@dataclass
class Range(InputPartition):
    """Members whose headers begin in a range of a file's bytes, and how many named files stand before; end -1: all."""

    path: str
    start: int
    end: int
    before: int


def _regular(member: tarfile.TarInfo) -> bool:
    return member.isreg() and bool(member.name)


def _header(block: bytes) -> bool:
    try:
        return len(block) == tarfile.BLOCKSIZE and any(block) and tarfile.nti(block[148:156]) in tarfile.calc_chksums(block)
    except tarfile.HeaderError:
        return False


def walked(path: str, start: int, end: int) -> tuple[list[int], int, list[int]]:
    """Of the members from a header on that begin before end: where the first ones begin, where the next one does (-1: there is none), and how many named files stand before each of those told and the next."""
    told, before, files = [], [], 0
    try:
        with open(path, "rb") as file:
            file.seek(start)
            with tarfile.open(fileobj=file) as archive:
                for member in archive:
                    if len(told) < TOLD and member.offset < end:
                        told.append(member.offset)
                        before.append(files)
                    if member.offset >= end:
                        return told, member.offset, [*before, files]
                    files += _regular(member)
                    archive.members = []
    except BROKEN:
        pass  # the task that reads it tells it
    return told, -1, [*before, files]


def _found(path: str, start: int, end: int) -> tuple[list[int], int, list[int]]:
    """As walked, from the first block that may be a header on, be it a member's or one within a content."""
    with open(path, "rb") as file:
        file.seek(start)
        for at in range(start, end, tarfile.BLOCKSIZE):
            if _header(file.read(tarfile.BLOCKSIZE)):
                try:
                    return walked(path, at, end)
                except ValueError:
                    break  # of a content
    return [], -1, [0]


def ranges(path: str, split: int, spark: SparkSession | None = None) -> list[Range]:
    """Ranges of about so many bytes, of RANGES at most.

    With a session tasks look for the members of their bytes. What one finds holds if the
    range before leads to a header that it told; else, as in a content that is an archive
    itself, its headers are walked again from where the range before leads to.
    """
    total = os.path.getsize(path)
    step = -(-max(split, -(-total // RANGES)) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
    if not path.endswith(".tar") or total <= step:
        return [Range(path, 0, -1, 0)]
    cuts = list(range(0, total, step))
    seen: dict[int, tuple] = {}
    if spark is not None:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                found = [_found(path, k, k + step) for k in f["id"].tolist()]
                yield pd.DataFrame({"id": f["id"], "told": [x[0] for x in found], "next": [x[1] for x in found], "before": [x[2] for x in found]})

        looked = spark.range(0, total, step, len(cuts)).mapInPandas(run, "id long, told array<long>, next long, before array<long>")
        seen = {r["id"]: (r["told"], r["next"], r["before"]) for r in looked.collect()}
    out, at, before = [], 0, 0
    for cut in cuts:
        if at < 0:
            break
        if at >= cut + step:
            continue  # a content that goes on
        told, after, files = seen.get(cut, ([], -1, [0]))
        if at not in told:
            told, after, files = walked(path, at, cut + step)
        if out:
            out[-1].end = at
        out.append(Range(path, at, -1, before))
        before += files[-1] - files[told.index(at)] if at in told else 0
        at = after
    return out


def archives(path: str) -> list[str]:
    return sorted(e.path for e in os.scandir(path) if e.is_file() and ARCHIVE.search(e.name)) if os.path.isdir(path) else [path]


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int, found: str | None = None) -> None:
        self.path, self.split, self.found = path, split, found

    def partitions(self) -> list[Range]:
        if self.found is not None:
            return [Range(*r) for r in json.loads(self.found)]
        return [r for f in archives(self.path) for r in ranges(f, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ["path", "entry", "name", "content"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary()]
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for row in self._members(partition):
            held.append(row)
            size += len(row[3] or b"")
            if size >= BATCH or len(held) >= 10_000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    @staticmethod
    def _members(part: Range) -> Iterator[tuple[str, str, str, bytes | None]]:
        shown, number = f"file:{part.path}", part.before
        try:
            with open(part.path, "rb") as file:
                file.seek(part.start)
                with tarfile.open(fileobj=file, mode="r:" if part.path.endswith(".tar") else "r|gz") as archive:
                    for member in archive:
                        if 0 <= part.end <= member.offset:
                            return
                        if _regular(member):
                            # A content beyond what a row holds is told by a null one.
                            content = archive.extractfile(member).read() if member.size < 1 << 31 else None
                            yield shown, f"{shown}#{number}:{member.name}", member.name, content
                            number += 1
                        archive.members = []
                    # The module takes a header that is cut short for the end.
                    if part.path.endswith(".tar") and 0 < os.path.getsize(part.path) - archive.offset < tarfile.BLOCKSIZE:
                        raise tarfile.ReadError("cut short")
        except BROKEN:
            yield shown, shown, os.path.basename(part.path), None


class TarMembers(DataSource):
    """Options: path (an archive, or a folder of some), split (bytes a task), ranges (as load found them; else the headers are walked when the scan is planned)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> Reader:
        return Reader(local_path(self.options["path"]), int(self.options.get("split", SPLIT)), self.options.get("ranges"))


def load(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """path, entry, name and content of each named file of the archives, as sources.structures.opened has them.

    A broken archive gives what can be read before the break and a row with no content.
    The path must be on storage that the driver and all executors mount.
    """
    spark.dataSource.register(TarMembers)
    found = [(r.path, r.start, r.end, r.before) for f in archives(local_path(path)) for r in ranges(f, split, spark)]
    return spark.read.format(FORMAT).option("split", split).option("ranges", json.dumps(found)).load(path)
