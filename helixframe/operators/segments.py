"""Filters, runs and segments of ordered rows.

Where a function takes spread, that deals the rows of a key over many tasks (see
scans), for keys that may be longer than a task should hold; without it a key is
one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scans


def in_order(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def backbone(df: DataFrame, atom: str = "atom", names: tuple[str, ...] = ("N", "CA", "C")) -> DataFrame:
    return df.filter(F.col(atom).isin(*names))


def drop_adjacent_repeats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first row of each run of one value."""
    before = F.lag(value).over(in_order(keys, order))
    return df.withColumn("_before", before).filter(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def drop_before_repeat(df: DataFrame, keys: list[str], order: list[str], value: str, keep: Column | None = None) -> DataFrame:
    """The last row of each run of one value, and rows for which keep holds."""
    after = F.lead(value).over(in_order(keys, order))
    stays = ~F.col(value).eqNullSafe(F.col("_after"))
    return df.withColumn("_after", after).filter(stays if keep is None else stays | keep).drop("_after")


def with_run_id(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run_id", spread: bool = False) -> DataFrame:
    """Adds the number, from 0, of the run of one value that a row is in."""
    if spread:
        rows = scans.changes(scans.ranged(df, keys, order), order, value, "_start")
        out = scans.scanned(rows, order, sums={name: F.col("_start")})
        return scans.plain(out.withColumn(name, F.col(name) - 1)).drop("_start")
    over = in_order(keys, order)
    starts = df.withColumn("_start", (~F.col(value).eqNullSafe(F.lag(value).over(over))).cast("long"))
    return starts.withColumn(name, F.sum("_start").over(over.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_start")


def run_heads(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One row for each run: its first."""
    return drop_adjacent_repeats(df, keys, order, value)


def chain_segments(df: DataFrame, keys: list[str], order: list[str], chain: str, opens: Column, spread: bool = False) -> DataFrame:
    """Adds segment, the run of one chain; rows of a run before the first for which opens holds go, and runs without one."""
    if spread:
        rows = scans.changes(scans.ranged(df, keys, order), order, chain, "_start")
        place = F.struct(*order, "_own")
        marks = {"_began": F.when(F.col("_start") == 1, place), "_opened": F.when(opens, place)}
        out = scans.scanned(rows, order, sums={"segment": F.col("_start")}, lasts=marks).filter("_opened >= _began")
        return scans.plain(out.withColumn("segment", F.col("segment") - 1)).drop("_start", *marks)
    runs = with_run_id(df, keys, order, chain, "segment")
    within = W.partitionBy(*keys, "segment").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return runs.withColumn("_open", F.max(F.coalesce(opens, F.lit(False)).cast("int")).over(within)).filter("_open = 1").drop("_open")


def gap_fragments(df: DataFrame, keys: list[str], order: list[str], number: str, marker: Column | None = None, spread: bool = False) -> DataFrame:
    """Adds fragment, from 0: a new one begins at a marked row whose number is more than one beyond the last marked row's.

    Without a marker all rows are marked. Rows before the first marked one go.
    """
    mark = F.lit(True) if marker is None else F.coalesce(marker, F.lit(False))
    if spread:
        rows = scans.ranged(df.withColumn("_mark", mark), keys, order)
        rows = scans.scanned(rows, order, lasts={"_last": F.when(F.col("_mark"), F.col(number))}, before=True)
        gap = F.coalesce(F.col("_mark") & (F.col(number) - F.col("_last") > 1), F.lit(False)).cast("long")
        out = scans.scanned(rows.withColumn("_gap", gap), order, sums={"fragment": F.col("_gap"), "_any": F.col("_mark").cast("long")}).filter("_any > 0")
        return scans.plain(out).drop("_mark", "_last", "_gap", "_any")
    over = in_order(keys, order)
    before = F.last(F.when(F.col("_mark"), F.col(number)), ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_mark", mark).withColumn("_gap", F.coalesce(F.col("_mark") & (F.col(number) - before > 1), F.lit(False)).cast("long"))
    upto = over.rowsBetween(W.unboundedPreceding, 0)
    out = marked.withColumn("fragment", F.sum("_gap").over(upto)).withColumn("_any", F.max(F.col("_mark").cast("int")).over(upto))
    return out.filter("_any = 1").drop("_mark", "_gap", "_any")


def renumber(df: DataFrame, keys: list[str], order: list[str], start: int = 0, name: str = "number", spread: bool = False) -> DataFrame:
    """Adds a number that ascends by one along the order, from start."""
    if spread:
        out = scans.scanned(scans.ranged(df, keys, order), order, sums={name: F.lit(1).cast("long")})
        return scans.plain(out.withColumn(name, F.col(name) - 1 + start))
    return df.withColumn(name, F.row_number().over(in_order(keys, order)) - 1 + start)


def collected(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, spread: bool = False) -> DataFrame:
    """keys and the list of each key's values, in order."""
    if spread:
        return scans.gathered(scans.ranged(df, keys, order), keys, order, F.col(value), name)
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return df.groupBy(*keys).agg(F.transform(held, lambda x: x["_value"]).alias(name))


def only_whole(df: DataFrame, keys: list[str], fragment: str = "fragment") -> DataFrame:
    """Rows of groups that are one fragment."""
    return df.withColumn("_n", F.max(fragment).over(W.partitionBy(*keys))).filter("_n = 0").drop("_n")


def split_text_runs(df: DataFrame, keys: list[str], order: list[str], chain: str, text: str, joiner: str = "\n") -> DataFrame:
    """keys, run_id, chain and the texts of each run, joined in order."""
    runs = with_run_id(df, keys, order, chain)
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return runs.groupBy(*keys, "run_id").agg(F.first(chain).alias(chain), F.array_join(F.transform(held, lambda x: x["_text"]), joiner).alias("piece"))


def every_third(values: Column, k: int, step: int = 3) -> Column:
    """Elements k, k + step, ... of an array."""
    return F.filter(values, lambda _, i: i % step == k)


def anchor_indices(n: Column, threshold: int) -> Column:
    """Evenly spaced indices of n residues, the first and the last among them: n // threshold + 2 of them."""
    if threshold < 1:
        raise ValueError("the threshold must be at least 1")
    inner = F.floor(n / threshold).cast("int")
    step = F.floor(n / (inner + 1)).cast("int")
    return F.concat(F.transform(F.sequence(F.lit(0), inner), lambda i: i * step), F.array((n - 1).cast("int")))


def blend(forward: Column, backward: Column) -> Column:
    """Elements that go over, from the first to the last, from one array to another."""
    n = F.size(forward)
    return F.transform(F.arrays_zip(forward.alias("f"), backward.alias("b")), lambda x, i: (x["f"] * (n - i) + x["b"] * i) / n)


def joined_segments(parts: Column, overlap: int) -> Column:
    """One array of arrays that follow one another, each but the last without its last elements, which the next begins with."""
    n = F.size(parts)
    return F.flatten(F.transform(parts, lambda x, i: F.when(i < n - 1, F.slice(x, F.lit(1), F.greatest(F.size(x) - overlap, F.lit(0)))).otherwise(x)))
