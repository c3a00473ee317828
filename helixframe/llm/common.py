"""Shared helpers: table reads, ASCII normalisation, sums before a key; and the library's tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialise, shared_dir

__all__ = ["ascii_lower", "forget", "materialise", "shared_dir", "sum_before", "table", "text_of", "with_schema"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() does that alone where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_of(column: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sum_before(rows: DataFrame, key: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """key and name: the sum of value over all rows of a lesser key, a number that no two rows share.

    In two steps, within blocks of keys and over the blocks' totals, so that no task
    holds all rows.
    """
    rows = rows.select(key, value, F.floor(F.col(key) / block).alias("_block"))
    own = F.sum(value).over(W.partitionBy("_block").orderBy(key)) - F.col(value)
    totals = rows.groupBy("_block").agg(F.sum(value).alias("_total"))
    totals = totals.select("_block", (F.sum("_total").over(W.orderBy("_block")) - F.col("_total")).alias("_before"))
    return rows.withColumn("_own", own).join(totals, "_block").select(key, (F.col("_own") + F.col("_before")).cast("long").alias(name))


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialise wrote and that nothing will read again."""
    for held in tables:
        for folder in {f.rsplit("/", 1)[0] for f in held.inputFiles()}:
            spark = held.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_schema(schema: T.StructType, fields: str) -> T.StructType:
    """A schema with more fields, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(fields).fields])
