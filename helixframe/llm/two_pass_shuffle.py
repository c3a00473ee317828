"""Sharding by a two-pass external shuffle (built-in functions only).

Pass one scatters records into memory-sized buckets by a seeded hash. Pass two
takes one bucket at a time, permutes it by Fisher-Yates and deals the permuted
sequence to the shards, so that their row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, sum_before, table

#: Text bytes that one bucket should hold, and those that a task of the second pass should.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 64 << 20


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and has_map(kind.elementType))


def without_maps(value: Column, kind: T.DataType) -> Column:
    """A value with its maps as arrays of entries, which can be hashed and put in order."""
    if not has_map(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[without_maps(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_maps(x, kind.elementType))
    entries = F.map_entries(value)
    return F.transform(entries, lambda x: F.struct(x["key"].alias("key"), without_maps(x["value"], kind.valueType).alias("value")))


def with_maps(value: Column, kind: T.DataType) -> Column:
    """The value that without_maps was given."""
    if not has_map(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[with_maps(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: with_maps(x, kind.elementType))
    return F.map_from_entries(F.transform(value, lambda x: F.struct(x["key"].alias("key"), with_maps(x["value"], kind.valueType).alias("value"))))


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 17,
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Rows (_shard int, _slot long, record struct) holding every input row once; record has all its columns.

    Slots run gapless from 0 in each shard and row counts differ by one at most.
    The permutation follows from the seed, the rows, where they lie in the input, and
    the number of buckets and partitions. Null columns, null and empty texts are
    records like any other; columns may bear any name, since the record stays a struct.
    Rows alike in all columns are dealt to many buckets. An empty table gives none.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    record = docs.select(F.struct(*[without_maps(F.col(f"`{c}`"), kinds[c]).alias(c) for c in docs.columns]).alias("record"))
    size = F.coalesce(F.octet_length(F.col("record")[text_col]), F.lit(0)) + 8
    total = record.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    # A row's number parts it from rows that are alike, so that many of these go to many buckets. Written, so that it stays.
    numbered = record.withColumn("row", F.monotonically_increasing_id())
    scattered = materialise(numbered.select("record", F.pmod(F.xxhash64(F.lit(seed), "record", "row"), F.lit(buckets)).alias("bucket")), "scattered")

    # Where each bucket's rows begin in the whole sequence; one row for each bucket.
    starts = sum_before(scattered.groupBy("bucket").count(), "bucket", "count", "start")

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES), 1)
    held = scattered.repartition(partitions, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
    # The sort-merge join hands buckets on in order of bucket: with that, the generator of
    # shuffle(), which is Fisher-Yates, gives a rerun task the same permutations again.
    ordered = held.hint("merge").join(starts, "bucket")
    permuted = ordered.select("start", F.shuffle("records", seed).alias("records"))
    place = F.col("start") + F.col("pos")
    record = F.struct(*[with_maps(F.col("record")[c], kinds[c]).alias(c) for c in docs.columns]) if has_map(docs.schema) else F.col("record")
    return permuted.select("start", F.posexplode("records").alias("pos", "record")).select(
        F.pmod(place, F.lit(shards)).cast("int").alias("_shard"), F.floor(place / shards).cast("long").alias("_slot"), record.alias("record")
    )


def write_shards(sharded: DataFrame, path: str, shards: int = 24) -> None:
    """Write one folder for each shard, its rows in order of slot."""
    sharded.repartition(shards, "_shard").sortWithinPartitions("_shard", "_slot").select("_shard", "_slot", "record.*").write.partitionBy("_shard").parquet(path)


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.col("record.text")
    return shuffle_into_shards(docs).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
