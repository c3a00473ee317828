"""Bit packing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_word(residue: Column, omega: Column, psi: Column, phi: Column, ca_c_n: Column, c_n_ca: Column, n_ca_c: Column) -> tuple[Column, Column]:
    """High and low 32 bits, as longs: 5 bits residue, 11 omega, 12 psi, 12 phi and three times 8 bits."""
    parts = [x.cast("long") for x in (residue, omega, psi, phi, ca_c_n, c_n_ca, n_ca_c)]
    r, o, s, p, a, b, c = parts
    high = F.shiftleft(r, 27).bitwiseOR(F.shiftleft(o, 16)).bitwiseOR(F.shiftleft(s, 4)).bitwiseOR(F.shiftright(p, 8))
    low = F.shiftleft(p.bitwiseAND(F.lit(255)), 24).bitwiseOR(F.shiftleft(a, 16)).bitwiseOR(F.shiftleft(b, 8)).bitwiseOR(c)
    return high, low


def word_bytes(high: Column, low: Column) -> Column:
    """The eight bytes of a word, highest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 8, "0") for x in (high, low)]))


def unpack_word(high: Column, low: Column) -> Column:
    """The seven fields of a word."""

    def bits(x: Column, shift: int, mask: int) -> Column:
        return F.shiftright(x, shift).bitwiseAND(F.lit(mask)).cast("int")

    phi = F.shiftleft(high.bitwiseAND(F.lit(15)), 8).bitwiseOR(bits(low, 24, 255)).cast("int")
    return F.struct(
        bits(high, 27, 31).alias("residue"), bits(high, 16, 0x7FF).alias("omega"), bits(high, 4, 0xFFF).alias("psi"), phi.alias("phi"),
        bits(low, 16, 255).alias("ca_c_n"), bits(low, 8, 255).alias("c_n_ca"), bits(low, 0, 255).alias("n_ca_c"),
    )


def pack_nibbles(values: Column) -> Column:
    """Bytes of two four-bit numbers each; the half that an odd count leaves over is 15."""
    count = F.ceil(F.size(values) / 2).cast("int")
    byte = lambda i: F.shiftleft(F.get(values, i * 2), 4).bitwiseOR(F.coalesce(F.get(values, i * 2 + 1), F.lit(15)))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), byte)).otherwise(F.array().cast("array<int>"))


def unpack_nibbles(packed: Column, count: Column) -> Column:
    """The first count four-bit numbers of packed bytes."""
    halves = F.flatten(F.transform(packed, lambda b: F.array(F.shiftright(b, 4).bitwiseAND(F.lit(15)), b.bitwiseAND(F.lit(15)))))
    return F.slice(halves, 1, count)
