"""Per-group quantizers: fit by aggregation, apply as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """keys, lo, hi, n_bin, disc_f (bins over range), cont_f (range over bins); a range of nothing gives 0 for both."""
    spread = F.col("hi") - F.col("lo")
    out = df.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    return out.select(*keys, "lo", "hi", F.lit(bins).alias("n_bin"), F.when(spread > 0, bins / spread).otherwise(0.0).alias("disc_f"), (spread / bins).alias("cont_f"))


def to_bin(value: Column, low: Column, disc_f: Column) -> Column:
    """Rounded half up."""
    return F.floor((value - low) * disc_f + 0.5).cast("int")


def to_bin_cut(value: Column, low: Column, disc_f: Column) -> Column:
    """Cut off; for a fixed range."""
    return F.floor((value - low) * disc_f).cast("int")


def from_bin(index: Column, low: Column, cont_f: Column) -> Column:
    return low + index * cont_f


def fixed_angle_bin(angle: Column, bins: int = 255) -> Column:
    return to_bin_cut(angle, F.lit(-180.0), F.lit(bins / 360.0))


def angle_short(angle: Column, bits: int = 16) -> Column:
    """An angle in steps of the circle over 2^bits, cut off towards zero and wrapped to 16 bits."""
    steps = (angle * (2**bits) / 360.0).cast("long")
    return (F.pmod(steps + 32768, F.lit(65536)) - 32768).cast("int")


def short_angle(steps: Column, bits: int = 16) -> Column:
    return steps * 360.0 / (2**bits)


def quantize(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """df with lo, hi, disc_f, cont_f, bin and restored.

    Groups are fitted by an aggregation that begins where rows are read, and each row
    looks up its group's: a group with very many rows never meets in one task. Null
    keys are a group of their own.
    """
    fits = fit(df, keys, value, bins).drop("n_bin")
    fits = fits.select(*[F.col(k).alias(f"_{k}") for k in keys], "lo", "hi", "disc_f", "cont_f")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    out = df.join(fits, same).drop(*[f"_{k}" for k in keys])
    out = out.withColumn("bin", to_bin(F.col(value), F.col("lo"), F.col("disc_f")))
    return out.withColumn("restored", from_bin(F.col("bin"), F.col("lo"), F.col("cont_f")))


def audit(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """quantize with diff, what is lost by it."""
    return quantize(df, keys, value, bins).withColumn("diff", F.col(value) - F.col("restored"))


def header(low: Column, high: Column, bins: Column, disc_f: Column, cont_f: Column) -> Column:
    """A quantizer's parameters, a line each."""
    from ..functions.strings import fixed_decimals

    named = (("MIN", fixed_decimals(low, 4)), ("MAX", fixed_decimals(high, 4)), ("N_BIN", bins.cast("string")), ("DISC_F", fixed_decimals(disc_f, 6)), ("CONT_F", fixed_decimals(cont_f, 6)))
    return F.concat(*[x for n, v in named for x in (F.lit(f"#{n}:"), v, F.lit("\n"))])


def fit_errors(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """keys, mean_err and max_err between values and what their bins restore."""
    error = F.abs(F.col(value) - F.col("restored"))
    return quantize(df, keys, value, bins).groupBy(*keys).agg(F.avg(error).alias("mean_err"), F.max(error).alias("max_err"))
