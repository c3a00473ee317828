"""Mixing sources by temperature.

A source's weight is its token share to a power, normalised. The power is bisected
until the weights have a target entropy or no source repeats beyond a limit. The
weights are realised as passes over permuted blocks: whole passes, and a last one
that ends where the source's budget does. What decides about a row is one row of
plan for its source, so texts are not moved. The plan is a table, however many
sources there are; a source has as many blocks as a block has rows, or so.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table, text_of

REPEATS, SEED = 2.0, 29
#: Different token totals of sources that the driver sums by itself; Spark sums more of them.
LOCAL_TOTALS = 100_000


def weights(shares: np.ndarray, power: float) -> np.ndarray:
    """Shares to a power, normalised; a share of nothing stays nothing."""
    raw = np.where(shares > 0, np.power(np.where(shares > 0, shares, 1.0), power), 0.0)
    return raw / raw.sum() if raw.sum() else raw


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def bisect(low: float, high: float, fits: Callable[[float], bool], steps: int = 60) -> float:
    """The least power for which fits holds, if it holds from there up to high."""
    if fits(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


#: For a power: the sum of the shares to that power, and the sum of these times the logarithms of their shares.
Sums = Callable[[float], tuple[float, float]]


@dataclass(frozen=True)
class Mix:
    """A source with a share of s has a weight of s ** power / norm and is passed over weight * total / tokens times."""

    power: float
    norm: float
    total: float


def solve(sums: Sums, least: float, largest: float, tokens: float, repeats: float | None = REPEATS, target_entropy: float | None = None, budget: int | None = None) -> Mix:
    """The power, by bisection. least and largest are tokens of sources that have any, tokens those of all.

    With repeats: the least power at which no source is passed over more often than
    that; else the power at which the entropy (nats) comes down to the target, or the
    closest that powers from 0 to 1 allow. Without a budget, the largest source is
    passed over once, and thus every row is used.
    """

    def mix(power: float) -> Mix:
        norm = sums(power)[0]
        return Mix(power, norm, float(budget) if budget is not None else largest * norm / (largest / tokens) ** power)

    def repeated(power: float) -> float:
        # Up to a power of one, the smallest source is passed over most often.
        m = mix(power)
        return (least / tokens) ** power / m.norm * m.total / least

    def entropy_at(power: float) -> float:
        norm, logs = sums(power)
        return math.log(norm) - power * logs / norm

    if repeats is not None:
        return mix(bisect(0.0, 1.0, lambda x: repeated(x) <= repeats * (1 + 1e-12)))
    return mix(bisect(0.0, 1.0, lambda x: entropy_at(x) <= (target_entropy if target_entropy is not None else math.inf)))


def local_sums(tokens: np.ndarray, times: np.ndarray) -> Sums:
    """tokens: totals of sources, without zeros; times: how many sources have each."""
    shares = tokens / (tokens * times).sum()

    def sums(power: float) -> tuple[float, float]:
        x = times * shares**power
        return float(x.sum()), float((x * np.log(shares)).sum())

    return sums


def table_sums(totals: DataFrame, tokens: float) -> Sums:
    """As local_sums, over a written table of tokens by source."""
    share = F.col("tokens") / tokens

    def sums(power: float) -> tuple[float, float]:
        x = F.pow(share, F.lit(power))
        r = totals.filter("tokens > 0").agg(F.sum(x), F.sum(x * F.log(share))).first()
        return r[0], r[1]

    return sums


def planned(totals: DataFrame, repeats: float | None, target_entropy: float | None, budget: int | None, local: int = LOCAL_TOTALS) -> DataFrame:
    """source, weight, epochs (whole passes) and left (tokens of the last one), from a written table of tokens by source. Sources without tokens get one pass."""
    full = totals.filter("tokens > 0")
    tokens, least, largest = full.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not tokens:
        return totals.select("source", F.lit(0.0).alias("weight"), F.lit(1).alias("epochs"), F.lit(0).cast("long").alias("left"))
    alike = full.groupBy("tokens").count().limit(local + 1).collect()
    sums = table_sums(totals, float(tokens)) if len(alike) > local else local_sums(np.array([r["tokens"] for r in alike], float), np.array([r["count"] for r in alike], float))
    m = solve(sums, float(least), float(largest), float(tokens), repeats, target_entropy, budget)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(tokens)), F.lit(m.power)) / F.lit(m.norm)).otherwise(0.0)
    passes = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(m.total) / F.col("tokens")).otherwise(1.0)
    whole = F.floor(F.col("passes") + 1e-9)
    left = F.greatest(F.round((F.col("passes") - whole) * F.col("tokens")), F.lit(0.0)).cast("long")
    return totals.withColumn("weight", weight).withColumn("passes", passes).select("source", "weight", whole.cast("int").alias("epochs"), left.alias("left"))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    repeats: float | None = REPEATS,
    target_entropy: float | None = None,
    budget: int | None = None,
    blocks: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Rows (record, source, weight, epoch, block_key, doc_key): each input row once for each pass that takes it.

    record holds all columns of the row, whatever their names. The order of a pass
    is that of (block_key, doc_key). Tokens are runs of characters other than ASCII
    white space; null and empty texts have none and go with their source. A null
    source counts as the empty one. Rows alike in id and text are taken together.
    A last pass takes rows until its budget is reached, the one that reaches it
    included. blocks: of each source; by default the square root of its rows, so that
    neither the blocks of a source nor the rows of one are many. An empty table gives
    an empty result.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    record = F.col("record")
    held = held.select(
        "record",
        F.coalesce(record[source_col].cast("string"), F.lit("")).alias("source"),
        F.coalesce(record[text_col].cast("string"), F.lit("")).alias("words"),
        F.xxhash64(record[id_col], record[text_col]).alias("key"),
    )
    own_blocks = F.lit(blocks).cast("long") if blocks else F.ceil(F.sqrt(F.count(F.lit(1))))
    deal = materialise(held.groupBy("source").agg(own_blocks.alias("blocks")), "sources")
    held = held.join(deal, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks"))).drop("blocks")

    sums = materialise(held.groupBy("source", "block").agg(F.sum(n_words(F.col("words"))).alias("tokens")), "blocks")
    totals = materialise(sums.groupBy("source").agg(F.sum("tokens").alias("tokens")), "totals")
    plan = materialise(planned(totals, repeats, target_entropy, budget), "plan")

    def block_key(epoch: Column, block: str = "block") -> Column:
        return F.xxhash64(F.lit(seed), epoch, "source", block)

    def doc_key(epoch: Column) -> Column:
        return F.xxhash64(F.lit(seed), epoch, "key")

    # The block in which a last pass ends, and then the row.
    ordered = sums.join(plan, "source").withColumn("bk", block_key(F.col("epochs")))
    before = F.sum("tokens").over(W.partitionBy("source").orderBy("bk", "block")) - F.col("tokens")
    ends = ordered.withColumn("before", before).filter("before < left and left <= before + tokens").groupBy("source").agg(F.min_by(F.struct("block", "bk", "epochs", (F.col("left") - F.col("before")).alias("rest")), "before").alias("end"))
    ending = materialise(ends.select("source", "end.*"), "ends")
    last = held.join(ending, ["source", "block"]).select("source", "rest", doc_key(F.col("epochs")).alias("dk"), n_words(F.col("words")).alias("tokens"))
    earlier = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("dk").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = last.withColumn("earlier", earlier).filter("earlier < rest").groupBy("source").agg(F.max("dk").alias("dk"))
    limits = materialise(plan.join(ending.select("source", "bk"), "source", "left").join(cuts, "source", "left"), "limits")

    # Written tables of a row for each source: Spark broadcasts them while they are small.
    used = held.join(limits, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    used = used.select("record", "source", "weight", "epoch", block_key(F.col("epoch")).alias("block_key"), doc_key(F.col("epoch")).alias("doc_key"), "epochs", "left", "bk", "dk")
    in_last = (F.col("left") > 0) & ((F.col("block_key") < F.col("bk")) | ((F.col("block_key") == F.col("bk")) & (F.col("doc_key") <= F.col("dk"))))
    return used.filter((F.col("epoch") < F.col("epochs")) | F.coalesce(in_last, F.lit(False))).select("record", "source", "weight", "epoch", "block_key", "doc_key")


def in_order(mixed: DataFrame) -> DataFrame:
    """The records of a mix in its order: pass by pass, block by block; the file and place of a written row follow it."""
    order = ["epoch", "block_key", "doc_key"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select("record.*")


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select(F.col("record.doc_id").alias("doc_id"), "source", n_words(text_of("record.text")).alias("n_tokens"), "weight", "epoch", "block_key", "doc_key")
