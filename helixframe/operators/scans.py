"""Scans along an order within keys, spread over tasks however few the keys are.

Rows are dealt out by ranges of the keys and the order. A range is scanned on its
own; one row for each key and range carries its sum and last value on to the ranges
behind it. Ordered strings and lists are put together range by range and then merged
in levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Pieces of neighbouring ranges that one level joins.
MERGED = 16


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with _key (the keys), _own (parts rows of one place) and _range, written so that ranges are the same whenever it is read."""
    held = df.withColumn("_key", F.struct(F.lit(0).alias("_"), *keys)).withColumn("_own", F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartitionByRange(parts, *(["_key"] if keys else []), *order, "_own")
    return materialise(dealt.withColumn("_range", F.spark_partition_id()), "scan")


def scanned(rows: DataFrame, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """ranged rows with, for each name, the sum or the last value that is not null of a column up to the row; before: up to the row before."""
    sums, lasts = sums or {}, lasts or {}
    within = W.partitionBy("_key", "_range").orderBy(*order, "_own").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    behind = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a key
    place = F.struct(*order, "_own")
    totals = rows.groupBy("_key", "_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()), *(F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_{n}") for n, c in lasts.items()))
    carried = totals.select("_key", "_range", *(F.sum(f"_{n}").over(behind).alias(f"_{n}") for n in sums), *(F.last(f"_{n}", ignorenulls=True).over(behind).alias(f"_{n}") for n in lasts))
    own = rows.withColumns({n: F.sum(c).over(within) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(within) for n, c in lasts.items()})
    none = F.lit(0).cast("long")
    out = own.join(carried, ["_key", "_range"])
    out = out.withColumns({n: F.coalesce(n, none) + F.coalesce(f"_{n}", none) for n in sums} | {n: F.coalesce(n, f"_{n}") for n in lasts})
    return out.drop(*(f"_{n}" for n in (*sums, *lasts)))


def plain(rows: DataFrame) -> DataFrame:
    """Rows without the columns of ranges."""
    return rows.drop("_key", "_own", "_range")


def changes(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """ranged rows with 1 where the value differs from the row before, or there is none, else 0."""
    held = scanned(rows, order, lasts={"_previous": F.struct(F.col(value).alias("v"))}, before=True)
    differs = F.col("_previous").isNull() | ~F.col(value).eqNullSafe(F.col("_previous.v"))
    return held.withColumn(name, differs.cast("long")).drop("_previous")


def gathered(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, joiner: str | None = None) -> DataFrame:
    """keys and the values of each key's rows in order, as a list, or as a string where a joiner is given.

    Ranges are put together first and neighbours of them level by level, so that no task
    holds more than the rows of a range or the result of a key.
    """
    def whole(parts: Column) -> Column:
        values = F.transform(F.array_sort(parts), lambda x: x["v"])
        return F.flatten(values) if joiner is None else F.array_join(values, joiner)

    first = F.transform(F.array_sort(F.collect_list(F.struct(*order, "_own", value.alias("v")))), lambda x: x["v"])
    pieces = rows.groupBy("_key", "_range").agg((first if joiner is None else F.array_join(first, joiner)).alias("v"))
    pieces = materialise(pieces.withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy("_range")) - 1), "pieces")
    most = pieces.agg(F.max("_n")).first()[0] or 0
    while most > 0:
        pieces = pieces.groupBy("_key", F.floor(F.col("_n") / MERGED).cast("int").alias("_n")).agg(whole(F.collect_list(F.struct("_n", "v"))).alias("v"))
        most //= MERGED
    return pieces.select(*(F.col("_key")[k].alias(k) for k in keys), F.col("v").alias(name))
