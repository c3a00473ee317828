"""Tables in the cluster's shared folder, and single files that many tasks write their parts of."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session within one machine gets one of its own where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="helixframe-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and what has been
    dealt out at random or by range stays so however often it is read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """A path on storage that all machines mount, which open() takes; a path of another file system is an error."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    scheme = path.split(":", 1)[0]
    if "://" in path or (":/" in path and "/" not in scheme):
        raise ValueError(f"{path}: plain files are written and read on mounted storage alone, not through {scheme}; use the form of folders of tables")
    return path


def write_parts(parts: DataFrame, path: str, size: int, overwrite: bool = False) -> int:
    """Writes parts (offset long, content binary) of a file of a known size; returns the bytes written.

    Each task writes its parts where they belong, so none holds the file, and one that
    runs again writes the same again. The path must be on storage that the driver and
    all executors mount.
    """
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    with open(path, "wb") as out:
        out.truncate(size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file = os.open(path, os.O_WRONLY)
        try:
            for f in frames:
                done = 0
                for offset, content in zip(f["offset"], f["content"], strict=True):
                    left, at = memoryview(bytes(content)), int(offset)
                    while left:
                        n = os.pwrite(file, left, at)
                        left, at, done = left[n:], at + n, done + n
                yield pd.DataFrame({"written": [done]})
        finally:
            os.fsync(file)
            os.close(file)

    written = parts.select("offset", "content").mapInPandas(run, "written long").agg(F.sum("written")).first()[0] or 0
    if written > size:
        raise OSError(f"{path}: {written} bytes for a file of {size}")
    return written


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content", overwrite: bool = False) -> DataFrame:
    """Writes a file for each row to a folder on storage that all executors mount; returns name and error of each.

    A file that is there already stays as it is, with an error, unless it may be
    overwritten. A file appears under its name when it is whole. Names are kept to
    the folder: what stands before the last slash goes.
    """
    os.makedirs(folder, exist_ok=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            errors: list[str | None] = []
            for n, c in zip(f["name"], f["content"], strict=True):
                path = os.path.join(folder, os.path.basename(n))
                if os.path.exists(path) and not overwrite:
                    errors.append("exists already")
                    continue
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as out:
                    out.write(bytes(c))
                os.replace(part, path)
                errors.append(None)
            yield pd.DataFrame({"name": f["name"], "error": errors})

    held = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).filter("content is not null")
    # Written, so that the files are not written again whenever the outcome is looked at.
    return materialise(held.mapInPandas(run, "name string, error string"), "files")


def write_text(lines: DataFrame, order: list[str], path: str, text: str = "text", overwrite: bool = False) -> int:
    """Writes one file of texts in an order, each task at its own places; returns its size."""
    from ..operators.lookup import keyed_offsets

    held = lines.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], F.col(text).cast("binary").alias("content"))
    laid = materialise(keyed_offsets(held, [f"_{k}" for k in range(len(order))], F.octet_length("content")), "text")
    size = laid.agg(F.sum("length")).first()[0] or 0
    write_parts(laid, path, size, overwrite)
    return size
