"""Keyed databases: one file of entries' bytes, an index of key, offset and length, and a lookup of key and name.

write and read keep one as folders of tables, which is what a cluster should use;
write_native and read_native as the plain files that other tools read.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup as L
from . import db_format
from .shared import local_path, materialise, shared_dir

#: Fixed value: the kind of database that the .dbtype file names.
DBTYPE = struct.pack("<i", 12)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="key long, offset long, length long", mode="FAILFAST")


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="key long, name string, file_no int", mode="FAILFAST", quote="")


def layout(entries: DataFrame, name: str = "name", content: str = "content", key: str | None = None) -> DataFrame:
    """name, content, key, offset and length of entries, keyed in order of name, or of a key that they have."""
    held = entries.select(F.col(name).alias("name"), F.col(content).alias("content"), *([F.col(key).cast("long").alias("own")] if key else []))
    out = L.keyed_offsets(held, ["own" if key else "name"], F.octet_length("content"))
    return out.withColumn("key", F.col("own")).drop("own") if key else out


def write(entries: DataFrame, path: str, name: str = "name", content: str = "content", key: str | None = None, mode: str = "errorifexists") -> None:
    """Writes entries, index and lookup as folders under path, index and lookup in order of key."""
    held = materialise(layout(entries, name, content, key), "layout")
    held.select("key", "content").write.mode(mode).parquet(f"{path}/data")
    held.select("key", "offset", "length").orderBy("key").write.mode(mode).csv(f"{path}/index", sep="\t")
    held.select("key", "name", F.lit(0).alias("file_no")).orderBy("key").write.mode(mode).csv(f"{path}/lookup", sep="\t", quote="")


def _lines(rows: DataFrame, line, file: str) -> DataFrame:
    """file, offset, length and content of a text file of one line for each row, in order of key."""
    laid = L.keyed_offsets(rows.select(F.col("key").alias("_key"), line.cast("binary").alias("content")), ["_key"], F.octet_length("content"))
    return laid.select(F.lit(file).alias("file"), "offset", "length", "content")


def write_native(entries: DataFrame, path: str, name: str = "name", content: str = "content", key: str | None = None, overwrite: bool = False, ended: bool = False) -> None:
    """Writes path, path.index, path.lookup and path.dbtype; ended: a zero byte after each entry, as texts have.

    Tasks write their own ranges of hidden files, so path must be on storage that all
    executors mount; the files appear together when all is written, or not at all.
    """
    path = local_path(path)
    if not overwrite and any(os.path.exists(path + f) for f in db_format.FILES):
        raise FileExistsError(path)
    held = entries.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"), *([F.col(key).alias("own")] if key else []))
    if ended:
        held = held.withColumn("content", F.concat("content", F.lit(bytearray(b"\0"))))
    held = materialise(layout(held, "name", "content", "own" if key else None), "layout")
    parts = [
        held.select(F.lit("").alias("file"), "offset", "length", "content"),
        _lines(held, F.concat(F.concat_ws("\t", "key", "offset", "length"), F.lit("\n")), ".index"),
        _lines(held, F.concat(F.concat_ws("\t", F.col("key"), F.coalesce("name", F.lit("")), F.lit("0")), F.lit("\n")), ".lookup"),
        held.sparkSession.createDataFrame([(".dbtype", 0, len(DBTYPE), bytearray(DBTYPE))], "file string, offset long, length long, content binary"),
    ]
    laid = materialise(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), "parts")
    sizes = {r["file"]: r["size"] for r in laid.groupBy("file").agg(F.sum("length").alias("size")).collect()}  # four rows
    db_format.save(laid, sizes, path, overwrite)


def is_native(path: str) -> bool:
    return os.path.exists(f"{path}.dbtype")


def _asked(spark: SparkSession, ids: list[str] | list[int], by_key: bool) -> DataFrame:
    rows = [(k, int(i) if by_key else str(i)) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "ord long, key long" if by_key else "ord long, name string")


def read(spark: SparkSession, path: str, ids: list | None = None, strict: bool = False, by_key: bool = False) -> DataFrame:
    """key, name and content of a written database; with ids, of those, as often and in the order that they are given (column ord).

    ids are names, or keys with by_key. Unknown ids are left out; strict makes them an
    error. No ids are all entries.
    """
    held = spark.read.parquet(f"{path}/data").join(read_lookup(spark, f"{path}/lookup"), "key", "left")
    held = held.select("key", F.coalesce("name", F.lit("")).alias("name"), "content")
    if not ids:
        return held
    return _of(_asked(spark, ids, by_key), held, strict, by_key).select("ord", "key", "name", "content")


def _of(asked: DataFrame, held: DataFrame, strict: bool, by_key: bool) -> DataFrame:
    column = "key" if by_key else "name"
    if strict and (lost := L.missing(asked, held, column).limit(5).collect()):
        raise KeyError(", ".join(str(r[column]) for r in lost))
    return asked.join(held, column)


def read_native(spark: SparkSession, path: str, ids: list | None = None, strict: bool = False, by_key: bool = False, cached: bool = False) -> DataFrame:
    """key, name, content of a database of plain files: path, path.index and path.lookup; ids as for read; cached: through cached_index.

    The index is dealt out by offset; each task reads its own ranges, so the data
    file must be on storage that the executors share.
    """
    if cached:
        index = cached_index(spark, path, "key" if by_key else "name")
    else:
        index = read_index(spark, f"{path}.index").join(read_lookup(spark, f"{path}.lookup"), "key", "left")
    index = index.select("key", F.coalesce("name", F.lit("")).alias("name"), "offset", "length")
    extra = []
    if ids:
        index, extra = _of(_asked(spark, ids, by_key), index, strict, by_key), ["ord"]
    index = index.select(*extra, "key", "name", "offset", "length")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "rb") as data:
            for f in frames:
                blobs = []
                for offset, length in zip(f["offset"], f["length"], strict=True):
                    data.seek(offset)
                    blobs.append(data.read(length))
                yield pd.DataFrame({**{c: f[c] for c in extra}, "key": f["key"], "name": f["name"], "content": blobs})

    schema = ", ".join([*(f"{c} long" for c in extra), "key long, name string, content binary"])
    return index.repartitionByRange("offset").sortWithinPartitions("offset").mapInPandas(run, schema)


def cached_index(spark: SparkSession, path: str, by: str = "key", buckets: int | None = None) -> DataFrame:
    """key, name, offset and length of a database as a bucketed, sorted table, made once for each state of the files.

    Keys or names (by) are then looked up without a shuffle of the index: a join deals
    out the other side alone. The table is in the session's catalog and its files are in
    the shared folder; a database that was written again gets another.
    """
    native = is_native(path) if "://" not in path else False
    parts = (f"{path}.index", f"{path}.lookup") if native else (f"{path}/index", f"{path}/lookup")
    index, lookup = read_index(spark, parts[0]), read_lookup(spark, parts[1])
    state = spark.read.format("binaryFile").load(list(parts)).select("path", "length", F.col("modificationTime").cast("string").alias("time"))
    mark = state.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "path", "length", "time"))), ";").cast("binary"))).first()[0]
    name = f"index_{by}_{mark}"
    if not spark.catalog.tableExists(name):
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = index.join(lookup.select("key", "name"), "key", "left").select("key", F.coalesce("name", F.lit("")).alias("name"), "offset", "length")
        target = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        rows.repartition(n, by).write.bucketBy(n, by).sortBy(by).option("path", target).saveAsTable(name)
    return spark.table(name)


class Database:
    """A database of either form: len(), entries by place or name, and a context manager; entries() is all of it as a DataFrame."""

    def __init__(self, spark: SparkSession, path: str, ids: list | None = None, strict: bool = False) -> None:
        self.spark, self.path, self.ids = spark, path, ids
        self.native = is_native(path)
        self._lookup = read_lookup(spark, f"{path}.lookup" if self.native else f"{path}/lookup")
        if strict and ids:
            _of(_asked(spark, ids, False), self._lookup, True, False)

    def entries(self) -> DataFrame:
        if self._lookup is None:
            raise ValueError("the database is closed")
        return (read_native if self.native else read)(self.spark, self.path, self.ids)

    def __len__(self) -> int:
        rows = self._lookup if not self.ids else _asked(self.spark, self.ids, False).join(self._lookup, "name")
        return rows.count()

    def __getitem__(self, item: int | str) -> tuple[str, bytes]:
        """(name, content) of the entry at a place in order of key, or of the ids asked for; or of a name."""
        if isinstance(item, str):
            found = self._lookup.filter(F.col("name") == item).limit(1).collect()
        elif self.ids:
            rows = _asked(self.spark, self.ids, False).join(self._lookup, "name").select("ord", "key", "name")
            found = L.at_index(rows, ["ord"], item).collect()
        else:
            found = L.at_index(self._lookup, ["key"], item).collect()
        if not found:
            raise (KeyError if isinstance(item, str) else IndexError)(item)
        row = (read_native if self.native else read)(self.spark, self.path, [found[0]["key"]], by_key=True).first()
        return row["name"], bytes(row["content"])

    def close(self) -> None:
        self._lookup = None

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
