"""Continuous ingest: new structure files become entries as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.entry_codec import INTERVAL
from ..plans.structures import compress_texts
from ..sources.structures import opened


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, interval: int = INTERVAL, repeats: str | None = "30 days", most_files: int | None = None) -> StreamingQuery:
    """Encodes each new file of a folder once and appends name, blob and error to a Parquet table, then stops.

    A batch that is run again writes its own folder anew, so entries come once. Of files
    of one content, whatever their names, the first gives entries and later ones do not,
    also in later batches: a state store keeps the digests of contents for as long as
    repeats says, counted by the files' times of change. None keeps all files.
    most_files: files of one batch at most.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if most_files:
        source = source.option("maxFilesPerTrigger", most_files)
    files = source.load(folder)
    if repeats:
        marked = files.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", repeats)
        files = marked.dropDuplicatesWithinWatermark(["digest"]).drop("digest")

    def write(batch: DataFrame, epoch: int) -> None:
        texts = opened(batch).select("entry", "name", "content")  # files of one name in different folders stay apart
        compress_texts(texts, interval).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
