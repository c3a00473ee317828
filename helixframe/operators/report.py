"""Aggregates and text reports: distances, counts, validity, sequences and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import fixed_decimals
from . import scans

#: Outcomes of a check, in order of precedence, and what is said of each.
VALIDITY = {
    "SUCCESS": "is valid",
    "E_BACKBONE_COUNT_MISMATCH": "has a number of backbone angles that differs from its residues",
    "E_SIDECHAIN_COUNT_MISMATCH": "has a number of side-chain angles that differs from its header",
    "E_TEMP_FACTOR_COUNT_MISMATCH": "has a number of confidence values that differs from its residues",
    "E_EMPTY_BACKBONE_ANGLE": "has backbone angles of zero only",
    "E_EMPTY_SIDECHAIN_ANGLE": "has side-chain angles of zero only",
    "E_EMPTY_TEMP_FACTOR": "has confidence values of zero only",
}


def rmsd(squares: Column) -> Column:
    """Root of the mean of squared distances; no superposition."""
    return F.sqrt(F.avg(squares))


def rmsd_report(pairs: DataFrame, keys: list[str], squares: Column, backbones: tuple[Column, Column], sides: tuple[str, str] = ("left", "right"), also: dict[str, Column] | None = None) -> DataFrame:
    """keys, n_residue, n_atom, backbone_rmsd, all_rmsd and error of zipped rows; also: aggregates to go with them.

    backbones: whether the row of each side is of the backbone. Where a side has no
    atoms, or the sides do not have as many, the error says so and the rest is null.
    """
    there = [F.col(s).isNotNull().alias(f"_{k}") for k, s in enumerate(sides)]
    of_backbone = [F.coalesce(b, F.lit(False)).alias(f"_b{k}") for k, b in enumerate(backbones)]
    held = pairs.select(*keys, squares.alias("_d2"), *there, *of_backbone, *(c.alias(f"_also_{n}") for n, c in (also or {}).items()))
    out = held.groupBy(*keys).agg(
        F.floor(F.count_if("_b0") / 3).cast("long").alias("n_residue"),
        F.count(F.lit(1)).alias("n_atom"),
        rmsd(F.when(F.col("_b0"), F.col("_d2"))).alias("backbone_rmsd"),
        rmsd(F.col("_d2")).alias("all_rmsd"),
        *(F.count_if(f"_{k}").alias(f"_{k}") for k in (0, 1)),
        *(F.count_if(f"_b{k}").alias(f"_b{k}") for k in (0, 1)),
        *(F.max(f"_also_{n}").alias(n) for n in also or {}),
    )
    differ = lambda what, a, b: F.concat(F.lit(f"the numbers of {what} differ: "), F.col(a).cast("string"), F.lit(" and "), F.col(b).cast("string"))
    error = (
        F.when(F.col("_0") == 0, "the first has no atoms")
        .when(F.col("_1") == 0, "the second has no atoms")
        .when(F.col("_0") != F.col("_1"), differ("atoms", "_0", "_1"))
        .when(F.col("_b0") != F.col("_b1"), differ("backbone atoms", "_b0", "_b1"))
    )
    out = out.withColumn("error", error)
    values = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("n_residue", "n_atom", "backbone_rmsd", "all_rmsd")]
    return out.select(*keys, *values, "error", *(also or {}))


def all_zero(value: Column) -> Column:
    """True where no value differs from zero, also where there is none."""
    return F.coalesce(F.bool_and(value == 0), F.lit(True))


def validity(backbone_ok: Column, side_ok: Column, temp_ok: Column, backbone_zero: Column, side_zero: Column, temp_zero: Column) -> Column:
    """The first outcome that applies."""
    tests = (~backbone_ok, ~side_ok, ~temp_ok, backbone_zero, side_zero, temp_zero)
    out = F
    for test, code in zip(tests, list(VALIDITY)[1:], strict=True):
        out = out.when(test, code)
    return out.otherwise("SUCCESS")


def validity_message(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in VALIDITY.items() for x in kv])[code]


def joined(df: DataFrame, keys: list[str], order: list[str], value: Column, joiner: str = "", name: str = "data", spread: bool = False) -> DataFrame:
    """keys and the values of each group, joined in order; spread: a group's rows over many tasks, then piece by piece."""
    if spread:
        return scans.gathered(scans.ranged(df, keys, order), keys, order, value, name, joiner)
    held = F.array_sort(F.collect_list(F.struct(*order, value.alias("_value"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["_value"]), joiner).alias(name))


def first_last(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(f"first_{value}"), F.max_by(value, order).alias(f"last_{value}"))


def fasta(title: Column, data: Column) -> Column:
    return F.concat(F.lit(">"), title, F.lit("\n"), data, F.lit("\n"))


def tsv(title: Column, count: Column, data: Column) -> Column:
    return F.concat_ws("\t", title, count.cast("string"), data)


def atom_line(serial: Column, atom: Column, residue: Column, chain: Column, number: Column, x: Column, y: Column, z: Column, temp: Column) -> Column:
    """An ATOM record of fixed columns; occupancy is 1.00 and the element the atom name's first letter."""

    def right(c: Column, width: int) -> Column:
        # Text that is too wide stays whole.
        c = c.cast("string")
        return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, " "))

    name = F.when(F.length(atom) >= 4, atom).otherwise(F.concat(F.lit(" "), F.rpad(atom, 3, " ")))
    return F.concat(
        F.lit("ATOM  "), right(serial, 5), F.lit(" "), name, F.lit(" "), right(residue, 3), F.lit(" "), chain, right(number, 4), F.lit("    "),
        *(right(fixed_decimals(v, 3), 8) for v in (x, y, z)), F.lit("  1.00"), right(fixed_decimals(temp, 2), 6), F.lit(" " * 10), right(F.substring(atom, 1, 1), 2), F.lit("  "),
    )


def entry_size(anchors: Column, title_length: Column, residues: Column, side_torsions: Column) -> Column:
    """Bytes of an encoded entry."""
    return 97 + 40 * anchors + title_length + 9 * residues + side_torsions
