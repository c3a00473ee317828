"""The short way in: single structures as bytes, and databases by name."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from .operators import entry_codec as E
from .sources import keyed_db


class Error(ValueError):
    """A structure that cannot be compressed."""


def _atoms(text: str) -> E.Atoms:
    lines = [x for x in text.splitlines() if x.startswith("ATOM")]
    if not lines:
        raise Error("no ATOM lines")
    if len({x[21] for x in lines}) > 1:
        raise Error("more than one chain")
    columns = [[x[12:16].strip() for x in lines], [x[17:20].strip() for x in lines], [int(x[22:26]) for x in lines], [int(x[6:11]) for x in lines]]
    coord = [[float(x[a : a + 8]) for a in (30, 38, 46)] for x in lines]
    return E.Atoms(*(np.array(c) for c in columns), np.array(coord), np.array([float(x[60:66]) for x in lines]), lines[0][21])


def compress(name: str, pdb_content: str, *, anchor_residue_threshold: int = E.INTERVAL) -> bytes:
    """The entry of a PDB text of one chain."""
    return E.encode(_atoms(pdb_content), name, anchor_residue_threshold)


def decompress(blob: bytes, alternate: bool = False) -> tuple[str, str]:
    """(name, PDB text) of an entry."""
    return decompress_many([blob], alternate)[0]


def decompress_many(blobs: list[bytes], alternate: bool = False) -> list[tuple[str, str]]:
    """(name, PDB text) of each entry; they are decoded together, which takes far less than one by one."""
    parsed = [E.parse(b) for b in blobs]
    return [(e.title, E.pdb_text(a, e.title)) for e, a in zip(parsed, E.decode_many(parsed, alternate), strict=True)]


def get_data(given: bytes | str) -> dict:
    """Angle series, sequence, confidence and coordinates of an entry, or of a PDB text as measured.

    Series of an entry have a value for each residue, those of a text one less.
    """
    if isinstance(given, bytes) and given[:4] == E.MAGIC:
        return get_data_many([given])[0]
    a = _atoms(given.decode() if isinstance(given, bytes) else given)
    p = a.coord[np.isin(a.atom, ("N", "CA", "C"))]
    t, angles = E.torsions(p), E.bond_angles(p)
    letters = dict(zip(E.NAMES, E.LETTERS, strict=True))
    first = E._residue_starts(a)
    return {
        "psi": t[0::3].tolist(), "omega": t[1::3].tolist(), "phi": t[2::3].tolist(), "torsion_angles": t.tolist(), "bond_angles": angles.tolist(),
        "residues": "".join(letters.get(x, "X") for x in a.residue[first]), "b_factors": a.temp[a.atom == "CA"].tolist(), "coordinates": a.coord.tolist(),
    }


def get_data_many(blobs: list[bytes]) -> list[dict]:
    """As get_data, of entries, which are decoded together."""
    parsed = [E.parse(b) for b in blobs]
    return [E.features(e, a) for e, a in zip(parsed, E.decode_many(parsed), strict=True)]


def open_database(spark: SparkSession, path: str, ids: list[str] | None = None, err_on_missing: bool = False) -> keyed_db.Database:
    """A database; of those ids, or of all where none are given. It has a length, entries by place, and closes itself in a with statement."""
    return keyed_db.Database(spark, path, ids, err_on_missing)


def split_pdb_by_chain(text: str) -> list[str]:
    """Pieces of a PDB text, a new one at every change of chain among its ATOM lines."""
    out: list[list[str]] = []
    last = None
    for line in text.splitlines():
        if line.startswith("ATOM"):
            if line[21] != last:
                out.append([])
                last = line[21]
            out[-1].append(line)
    return ["\n".join(x) + "\n" for x in out]
