"""Joins by name and key, positional joins, keyed offsets and order."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialise


def names_to_keys(names: DataFrame, lookup: DataFrame, name: str = "name", key: str = "key") -> DataFrame:
    """names with their keys, null where unknown; order and repeats of names stay as they are."""
    return names.join(lookup.select(F.col(name), F.col(key)), name, "left")


def keys_to_names(rows: DataFrame, lookup: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    """rows with their names, empty where unknown."""
    return rows.join(lookup.select(F.col(key), F.col(name)), key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def subset(ids: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Rows of table for each id, as often as the id is asked for."""
    return ids.join(table, name)


def missing(ids: DataFrame, table: DataFrame, name: str) -> DataFrame:
    return ids.join(table, name, "left_anti")


def with_dictionary(df: DataFrame, dictionary: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """df with the dictionary's columns. A dictionary is a small table, which is broadcast: dealt out by its keys, df would be in as few tasks as it has.

    strict: a key without an entry is an error, as soon as its row is computed.
    """
    value = next(c for c in dictionary.columns if c != key)
    out = df.join(F.broadcast(dictionary), key, "left")
    if strict:
        out = out.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string")))))
    return out


def zip_rows(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """keys, place, and rows of two frames side by side, by their place within keys; null where a frame has no row there.

    Frames of unequal size are told by rows that have one side. Null keys are alike.
    """
    over = W.partitionBy(*keys).orderBy(*order)
    key = F.struct(F.lit(0).alias("_"), *keys).alias("_key")
    sides = [df.select(key, F.struct(*df.columns).alias(n), F.row_number().over(over).alias("place")) for df, n in zip((a, b), names, strict=True)]
    return sides[0].join(sides[1], ["_key", "place"], "full").select(*(F.col("_key")[k].alias(k) for k in keys), "place", *names)


#: Rows that a selection samples for each place at a time, and that it sorts.
SAMPLED, SORTED = 32_768, 100_000


def at_index(df: DataFrame, order: list[str], index: int, most: int = SORTED) -> DataFrame:
    """The row at a place from 0 in order (null first), or from the end for a negative one. Beyond the ends there is none.

    A place among rows alike in the order may be any of theirs.
    """
    return at_indices(df, order, [index], "_place", most).drop("_place")


def at_indices(df: DataFrame, order: list[str], indices: Iterable[int], name: str, most: int = SORTED) -> DataFrame:
    """As at_index, the rows at several places, with the place as a column.

    A place lies between two values of a sample that stand a little before and behind it;
    rows below and between are counted, for all places in one scan, and what holds the
    place is sampled again until it is short enough to be sorted. The sample bears on the
    time alone.
    """
    place = F.struct(*order)
    kind = df.select(place.alias("p")).schema["p"].dataType
    total = df.count()
    # Of each place its bounds, (value, whether with it), the rows before them and those within.
    spans = [{"index": i, "place": i + total * (i < 0), "low": None, "high": None, "before": 0, "rows": total, "alike": False, "stuck": False} for i in indices]
    spans = [s for s in spans if 0 <= s["place"] < total]

    def value(v: tuple) -> Column:
        return F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(v, kind.fields, strict=True)])

    def inside(s: dict) -> Column:
        out = F.lit(True)
        for end, under, upto in (("low", place.__gt__, place.__ge__), ("high", place.__lt__, place.__le__)):
            if s[end] is not None:
                v, with_it = s[end]
                out = out & (upto if with_it else under)(value(v))
        return out

    seed = 0
    while wide := [s for s in spans if s["rows"] > most and not s["alike"]]:
        seed += 1
        held = df.select(*order, F.array(*map(inside, wide)).alias("_in")).filter(F.exists("_in", lambda x: x))
        share = min(1.0, SAMPLED * len(wide) / sum(s["rows"] for s in wide))
        sample = held.sample(share, seed).orderBy(*order).collect()
        counts, cuts = [], {}
        for k, s in enumerate(wide):
            own = [tuple(r[c] for c in order) for r in sample if r["_in"][k]]
            if own:
                part = (s["place"] - s["before"] + 0.5) / s["rows"]
                at, off = part * len(own), 0.0 if s["stuck"] or share == 1 else 4 * math.sqrt(len(own) * part * (1 - part)) + 4
                low = own[math.floor(at - off)] if at >= off else None
                high = own[math.floor(at + off)] if at + off < len(own) else None
                cuts[k] = low, high
                begins = F.lit(True) if low is None else place >= value(low)
                ends = F.lit(True) if high is None else place <= value(high)
                counts += [F.count_if(inside(s) & ~begins).alias(f"_below{k}"), F.count_if(inside(s) & begins & ends).alias(f"_between{k}")]
        found = df.agg(*counts).first() if counts else None
        for k, (low, high) in cuts.items():
            s, below, between = wide[k], found[f"_below{k}"], found[f"_between{k}"]
            was, own = s["rows"], s["place"] - s["before"]
            if own < below:
                s |= {"high": (low, False), "rows": below}
            elif own < below + between:
                s |= {"low": s["low"] if low is None else (low, True), "high": s["high"] if high is None else (high, True), "before": s["before"] + below, "rows": between, "alike": low is not None and low == high}
            else:
                s |= {"low": (high, False), "before": s["before"] + below + between, "rows": was - below - between}
            # Where nothing was parted off, by few values that come often, the next cut is at one value.
            s["stuck"] = s["rows"] == was

    out = df.limit(0).withColumn(name, F.lit(0))
    for s in spans:
        rows = df.filter(inside(s))
        row = rows.limit(1) if s["alike"] else rows.orderBy(*order).offset(s["place"] - s["before"]).limit(1)
        out = out.unionByName(row.withColumn(name, F.lit(s["index"])))
    return out


def by_key(index: DataFrame, key: int) -> DataFrame:
    """The row of a stored key: a filter that reaches the scan, without a sort. An unknown key gives none."""
    return index.filter(F.col("key") == key)


def locate(keys: DataFrame, index: DataFrame) -> DataFrame:
    """keys with the offset and length that an index has for them; -1 and 0 where it has none."""
    out = keys.join(index.select("key", "offset", "length"), "key", "left")
    return out.withColumn("offset", F.coalesce("offset", F.lit(-1).cast("long"))).withColumn("length", F.coalesce("length", F.lit(0).cast("long")))


def slices(df: DataFrame, ranges: DataFrame | None, place: str = "pos") -> DataFrame:
    """Rows in [begin, end) of each range, with the range's columns; all rows where no ranges are given.

    Ranges are cut into blocks of places, so that the join is on equal blocks.
    """
    if ranges is None:
        return df
    block = 1024
    cut = ranges.filter("end > begin").withColumn("_block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    held = df.withColumn("_block", F.floor(F.col(place) / block))
    return held.join(cut, "_block").filter((F.col(place) >= F.col("begin")) & (F.col(place) < F.col("end"))).drop("_block")


def alternate_order(df: DataFrame, atom: str, atoms: list[str]) -> Column:
    """A sort key: an atom's place in a list; those not in it come last."""
    place = F.array_position(F.array(*[F.lit(a) for a in atoms]), F.col(atom))
    return F.when(place > 0, place).otherwise(len(atoms) + 1)


def keyed_offsets(df: DataFrame, order: list[str], length: Column) -> DataFrame:
    """Adds key (from 0, in order), offset and length.

    Prefix sums in two steps: within ranges of the order, and over the totals of the
    ranges, so that no task holds all rows. The ranges are a column of a written
    table: both steps see the same ones.
    """
    ranged = df.withColumn("length", length.cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    over = W.partitionBy("_range").orderBy(*order)
    own = ranged.withColumn("_n", F.row_number().over(over) - 1).withColumn("_sum", F.sum("length").over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col("length"))
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), F.sum("length").alias("_bytes"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = totals.select("_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_rows", "_bytes")))
    out = own.join(starts, "_range")
    return out.withColumn("key", (F.col("_n") + F.col("_rows0")).cast("long")).withColumn("offset", (F.col("_sum") + F.col("_bytes0")).cast("long")).drop("_range", "_n", "_sum", "_rows0", "_bytes0")
