"""Residue codes and side-chain geometry."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue names and one-letter codes, by index.
NAMES = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "ASX", "GLX", "STP", "UNK"]
LETTERS = "ARNDCQEGHILKMFPSTWYVBZ*X"

# Per residue the atoms after N, CA and C, each with the atom it is bonded to, the bond's length and
# the angle at that atom; then the alternate order of atoms.
GEOMETRY: dict[str, tuple[list[tuple[str, str, float, float]], list[str]]] = {
    "ALA": (
        [
            ("O", "C", 1.23, 120.31),
            ("CB", "CA", 1.52, 110.852),
        ],
        ["N", "CA", "C", "CB", "O"],
    ),
    "ARG": (
        [
            ("O", "C", 1.23, 119.745),
            ("CB", "CA", 1.53, 110.579),
            ("CG", "CB", 1.53, 113.233),
            ("CD", "CG", 1.52, 110.787),
            ("NE", "CD", 1.46, 111.919),
            ("CZ", "NE", 1.32, 125.192),
            ("NH1", "CZ", 1.31, 120.077),
            ("NH2", "CZ", 1.31, 120.077),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD", "NE", "NH1", "NH2", "CZ"],
    ),
    "ASN": (
        [
            ("O", "C", 1.23, 120.313),
            ("CB", "CA", 1.52, 110.852),
            ("CG", "CB", 1.52, 113.232),
            ("OD1", "CG", 1.23, 120.85),
            ("ND2", "CG", 1.325, 116.48),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "ND2", "OD1"],
    ),
    "ASP": (
        [
            ("O", "C", 1.23, 121.051),
            ("CB", "CA", 1.53, 110.871),
            ("CG", "CB", 1.52, 113.232),
            ("OD1", "CG", 1.248, 118.344),
            ("OD2", "CG", 1.248, 118.344),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "OD1", "OD2"],
    ),
    "CYS": (
        [
            ("O", "C", 1.23, 120.063),
            ("CB", "CA", 1.53, 111.078),
            ("SG", "CB", 1.8, 113.817),
        ],
        ["N", "CA", "C", "CB", "O", "SG"],
    ),
    "GLN": (
        [
            ("O", "C", 1.23, 120.211),
            ("CB", "CA", 1.53, 109.5),
            ("CG", "CB", 1.52, 113.292),
            ("CD", "CG", 1.52, 112.811),
            ("OE1", "CD", 1.23, 121.844),
            ("NE2", "CD", 1.32, 116.5),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD", "NE2", "OE1"],
    ),
    "GLU": (
        [
            ("O", "C", 1.23, 120.594),
            ("CB", "CA", 1.53, 110.538),
            ("CG", "CB", 1.52, 113.82),
            ("CD", "CG", 1.52, 112.912),
            ("OE1", "CD", 1.25, 118.479),
            ("OE2", "CD", 1.25, 118.479),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD", "OE1", "OE2"],
    ),
    "GLY": (
        [
            ("O", "C", 1.23, 120.522),
        ],
        ["N", "CA", "C", "O"],
    ),
    "HIS": (
        [
            ("O", "C", 1.23, 120.548),
            ("CB", "CA", 1.53, 111.329),
            ("CG", "CB", 1.5, 113.468),
            ("ND1", "CG", 1.38, 122.85),
            ("CD2", "CG", 1.36, 130.61),
            ("CE1", "ND1", 1.33, 108.589),
            ("NE2", "CD2", 1.38, 107.439),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD2", "ND1", "CE1", "NE2"],
    ),
    "ILE": (
        [
            ("O", "C", 1.235, 120.393),
            ("CB", "CA", 1.54, 111.983),
            ("CG1", "CB", 1.53, 110.5),
            ("CG2", "CB", 1.52, 110.5),
            ("CD1", "CG1", 1.51, 113.97),
        ],
        ["N", "CA", "C", "CB", "O", "CG1", "CG2", "CD1"],
    ),
    "LEU": (
        [
            ("O", "C", 1.235, 120.211),
            ("CB", "CA", 1.53, 110.418),
            ("CG", "CB", 1.53, 116.1),
            ("CD1", "CG", 1.52, 110.58),
            ("CD2", "CG", 1.52, 110.58),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD1", "CD2"],
    ),
    "LYS": (
        [
            ("O", "C", 1.23, 120.54),
            ("CB", "CA", 1.53, 109.5),
            ("CG", "CB", 1.52, 113.83),
            ("CD", "CG", 1.52, 111.79),
            ("CE", "CD", 1.52, 111.79),
            ("NZ", "CE", 1.49, 112.25),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD", "CE", "NZ"],
    ),
    "MET": (
        [
            ("O", "C", 1.23, 120.148),
            ("CB", "CA", 1.53, 110.833),
            ("CG", "CB", 1.52, 113.68),
            ("SD", "CG", 1.8, 112.773),
            ("CE", "SD", 1.79, 100.61),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "SD", "CE"],
    ),
    "PHE": (
        [
            ("O", "C", 1.23, 120.283),
            ("CB", "CA", 1.53, 110.846),
            ("CG", "CB", 1.51, 114.0),
            ("CD1", "CG", 1.385, 120.0),
            ("CD2", "CG", 1.385, 120.0),
            ("CE1", "CD1", 1.385, 120.0),
            ("CE2", "CD2", 1.385, 120.0),
            ("CZ", "CE1", 1.385, 120.0),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD1", "CD2", "CE1", "CE2", "CZ"],
    ),
    "PRO": (
        [
            ("O", "C", 1.23, 120.6),
            ("CB", "CA", 1.53, 111.372),
            ("CG", "CB", 1.49, 104.21),
            ("CD", "CG", 1.5, 105.0),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD"],
    ),
    "SER": (
        [
            ("O", "C", 1.23, 120.475),
            ("CB", "CA", 1.53, 110.248),
            ("OG", "CB", 1.417, 111.132),
        ],
        ["N", "CA", "C", "CB", "O", "OG"],
    ),
    "THR": (
        [
            ("O", "C", 1.23, 120.252),
            ("CB", "CA", 1.53, 110.075),
            ("OG1", "CB", 1.43, 109.442),
            ("CG2", "CB", 1.52, 111.457),
        ],
        ["N", "CA", "C", "CB", "O", "CG2", "OG1"],
    ),
    "TRP": (
        [
            ("O", "C", 1.23, 120.178),
            ("CB", "CA", 1.53, 110.852),
            ("CG", "CB", 1.5, 114.1),
            ("CD1", "CG", 1.36, 126.712),
            ("CD2", "CG", 1.44, 126.712),
            ("NE1", "CD1", 1.38, 109.959),
            ("CE2", "CD2", 1.41, 107.842),
            ("CE3", "CD2", 1.4, 133.975),
            ("CZ2", "CE2", 1.4, 120.0),
            ("CZ3", "CE3", 1.384, 120.0),
            ("CH2", "CZ2", 1.367, 120.0),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD1", "CD2", "CE2", "CE3", "NE1", "CH2", "CZ2", "CZ3"],
    ),
    "TYR": (
        [
            ("O", "C", 1.235, 120.608),
            ("CB", "CA", 1.53, 110.852),
            ("CG", "CB", 1.51, 113.744),
            ("CD1", "CG", 1.39, 120.937),
            ("CD2", "CG", 1.39, 120.937),
            ("CE1", "CD1", 1.38, 120.0),
            ("CE2", "CD2", 1.38, 120.0),
            ("CZ", "CE1", 1.378, 120.0),
            ("OH", "CZ", 1.375, 120.0),
        ],
        ["N", "CA", "C", "CB", "O", "CG", "CD1", "CD2", "CE1", "CE2", "OH", "CZ"],
    ),
    "VAL": (
        [
            ("O", "C", 1.235, 120.472),
            ("CB", "CA", 1.54, 111.381),
            ("CG1", "CB", 1.52, 110.7),
            ("CG2", "CB", 1.52, 110.4),
        ],
        ["N", "CA", "C", "CB", "O", "CG1", "CG2"],
    ),
}

# Backbone bond lengths; the one before CA is shorter in proline.
N_CA, CA_C, C_N, PRO_N_CA = 1.4581, 1.5281, 1.3311, 1.353


@dataclass(frozen=True)
class SideAtom:
    name: str
    before: tuple[str, str, str]
    length: float
    angle: float


@dataclass(frozen=True)
class Residue:
    name: str
    letter: str
    side: tuple[SideAtom, ...]
    alternate: tuple[str, ...]

    @property
    def atoms(self) -> tuple[str, ...]:
        return ("N", "CA", "C", *(a.name for a in self.side))


@lru_cache(1)
def dictionary() -> dict[str, Residue]:
    """Residues by name. An atom's three predecessors follow its bonds back; O and CB have their own."""
    out = {}
    for name, (side, alternate) in GEOMETRY.items():
        bonded = {"CA": "N", "C": "CA", "N": "N"}
        atoms = []
        for atom, to, length, angle in side:
            bonded[atom] = to
            back = (bonded[bonded[to]], bonded[to], to)
            before = {"O": ("N", "CA", "C"), "CB": ("O", "C", "CA")}.get(atom, back)
            atoms.append(SideAtom(atom, before, length, angle))
        out[name] = Residue(name, LETTERS[NAMES.index(name)], tuple(atoms), tuple(alternate))
    out["UNK"] = Residue("UNK", "X", (), ("N", "CA", "C"))
    return out


def _lookup(pairs: dict, key: Column, default) -> Column:
    entries = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.coalesce(F.create_map(*entries)[key], F.lit(default))


def three_to_one(name: Column) -> Column:
    """One-letter code of a residue name; X where unknown."""
    return _lookup(dict(zip(NAMES, LETTERS, strict=True)), name, "X")


def one_to_three(letter: Column) -> Column:
    return _lookup(dict(zip(LETTERS, NAMES, strict=True)), letter, "UNK")


def index_to_one(index: Column) -> Column:
    return _lookup(dict(enumerate(LETTERS)), index, "X")


def one_to_index(letter: Column) -> Column:
    return _lookup({c: i for i, c in enumerate(LETTERS)}, letter, len(LETTERS) - 1)


def index_to_three(index: Column) -> Column:
    return _lookup(dict(enumerate(NAMES)), index, "UNK")


def three_to_index(name: Column) -> Column:
    return _lookup({n: i for i, n in enumerate(NAMES)}, name, len(NAMES) - 1)


def side_chain_torsions(name: Column) -> Column:
    """Torsions that are stored for a residue's side chain, O included."""
    return _lookup({n: len(r.side) for n, r in dictionary().items()}, name, 0)


def alphabetical() -> list[str]:
    """Names of the residues that have a dictionary entry, in alphabetical order."""
    return sorted(dictionary())
