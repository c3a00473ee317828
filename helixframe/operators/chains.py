"""Angles and lengths along ordered points, side by side or in one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .segments import in_order


def points_of(values: Column) -> Column:
    """Points of three consecutive numbers each; a rest of one or two numbers is left out."""
    n = F.floor(F.size(values) / 3).cast("int")
    point = lambda i: G.point(values[i * 3], values[i * 3 + 1], values[i * 3 + 2])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), point)).otherwise(F.array())


def exploded(df: DataFrame, key: str, values: str) -> DataFrame:
    """key, pos and coord, a row for each point."""
    return df.select(key, F.posexplode(points_of(F.col(values))).alias("pos", "coord"))


def _leads(keys: list[str], order: list[str], coord: str, n: int) -> list[Column]:
    over = in_order(keys, order)
    return [F.col(coord), *(F.lead(coord, k).over(over) for k in range(1, n))]


def torsions(df: DataFrame, keys: list[str], order: list[str], coord: str = "coord") -> DataFrame:
    """Adds the torsion of a row's point and the three after it; rows without them go."""
    names = [f"_p{k}" for k in range(4)]
    out = df.select("*", *[c.alias(n) for c, n in zip(_leads(keys, order, coord, 4), names, strict=True)]).filter(F.col("_p3").isNotNull())
    return G.with_torsion(out, names).drop(*names)


def bond_angles(df: DataFrame, keys: list[str], order: list[str], coord: str = "coord") -> DataFrame:
    """Adds the angle at the next row's point; rows without two after them go."""
    names = [f"_p{k}" for k in range(3)]
    out = df.select("*", *[c.alias(n) for c, n in zip(_leads(keys, order, coord, 3), names, strict=True)]).filter(F.col("_p2").isNotNull())
    return out.withColumn("angle", G.bond_angle(*map(F.col, names))).drop(*names)


def bond_lengths(df: DataFrame, keys: list[str], order: list[str], coord: str = "coord") -> DataFrame:
    """Adds the distance to the next row's point; the last row goes."""
    out = df.withColumn("_next", F.lead(coord).over(in_order(keys, order))).filter(F.col("_next").isNotNull())
    return out.withColumn("length", G.distance(F.col(coord), F.col("_next"))).drop("_next")


def breaks(df: DataFrame, keys: list[str], order: list[str], cutoff: float = 2.0, coord: str = "coord") -> DataFrame:
    """Rows whose next point is further away than the cutoff."""
    return bond_lengths(df, keys, order, coord).filter(F.col("length") > cutoff)


def _along(points: Column, span: int, at) -> Column:
    """at(points, i) for each run of span points; points are computed once."""

    def over(p: Column) -> Column:
        n = F.size(p)
        return F.when(n >= span, F.transform(F.sequence(F.lit(0), n - span), lambda i: at(p, i))).otherwise(F.array().cast("array<double>"))

    return G.let(points, over)


def torsion_array(points: Column) -> Column:
    """Torsions of an array of points, without a shuffle."""
    return _along(points, 4, lambda p, i: G.torsion(p[i], p[i + 1], p[i + 2], p[i + 3]))


def angle_array(points: Column) -> Column:
    return _along(points, 3, lambda p, i: G.bond_angle(p[i], p[i + 1], p[i + 2]))


def rebuild(first: Column, lengths: Column, angles: Column, twists: Column) -> Column:
    """Points from the first three on: each from the three before it and its length, angle and torsion."""
    steps = F.arrays_zip(lengths.alias("r"), angles.alias("a"), twists.alias("t"))

    def step(held: Column, s: Column) -> Column:
        n = F.size(held)
        return F.concat(held, F.array(G.place(held[n - 3], held[n - 2], held[n - 1], s["r"], s["a"], s["t"])))

    return F.aggregate(steps, first, step)


def bond_audit(atoms: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """atoms (atom, chain, x, y, z) with bond_name, bond_angle and bond_length to the atom before.

    An atom that bears the name of the one before is left out. All three are null at
    the beginning and at a change of chain, and the angle is at the end.
    """
    over = in_order(keys, order)
    point = F.struct("x", "y", "z")
    rows = atoms.withColumn("_before", F.lag("atom").over(over)).filter(~F.col("atom").eqNullSafe(F.col("_before")))
    rows = rows.withColumns({"_p": F.lag(point).over(over), "_n": F.lead(point).over(over), "_name": F.lag("atom").over(over), "_chain": F.lag("chain").over(over), "_c": point})
    bound = F.col("_chain") == F.col("chain")
    return rows.select(
        *atoms.columns,
        F.when(bound, F.concat_ws("_", "_name", "atom")).alias("bond_name"),
        F.when(bound & F.col("_n").isNotNull(), G.bond_angle(F.col("_p"), F.col("_c"), F.col("_n"))).alias("bond_angle"),
        F.when(bound, G.distance(F.col("_p"), F.col("_c"))).alias("bond_length"),
    )
