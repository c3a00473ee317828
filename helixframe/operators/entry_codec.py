"""Encoded entries: the compact binary form of one chain fragment, and back.

A fragment's backbone becomes quantised torsions and bond angles with stored anchor
residues, its side chains quantised torsions, its confidence one byte a residue.
Decoding places atom after atom, forwards and backwards between anchors, and blends
the two. Entries are independent, so this runs in Arrow batches over (name, atoms)
rows; the entries of a batch are decoded together, each step for all of them.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.residues import C_N, CA_C, LETTERS, N_CA, NAMES, PRO_N_CA, dictionary
from .report import validity_message

# The format's mark, bins of each series in the header's order, and the anchor interval by default.
MAGIC = b"FCMP"
SERIES = ("phi", "psi", "omega", "n_ca_c", "ca_c_n", "c_n_ca")
BINS = {"phi": 4095, "psi": 4095, "omega": 2047, "n_ca_c": 255, "ca_c_n": 255, "c_n_ca": 255}
HEADER = struct.Struct("<HHHHBcxxIccxxI6f6f")
INTERVAL = 25


class EntryError(ValueError):
    """An input that cannot be an entry, or bytes that are none."""


@dataclass
class Atoms:
    """Atoms in order; residue is a residue's name and number its number."""

    atom: np.ndarray
    residue: np.ndarray
    number: np.ndarray
    serial: np.ndarray
    coord: np.ndarray
    temp: np.ndarray
    chain: str = "A"


@dataclass
class Entry:
    title: str
    chain: str
    first_number: int
    first_serial: int
    n_atom: int
    codes: np.ndarray
    anchors: np.ndarray
    anchor_coord: np.ndarray
    oxt: np.ndarray | None
    low: np.ndarray
    step: np.ndarray
    bins: dict[str, np.ndarray]
    side: np.ndarray
    temp_low: float
    temp_step: float
    temp: np.ndarray
    names: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.names = [NAMES[c] if c < len(NAMES) else "UNK" for c in self.codes]

    def series(self, name: str) -> np.ndarray:
        k = SERIES.index(name)
        return self.low[k] + self.bins[name] * self.step[k]

    def temperatures(self) -> np.ndarray:
        return self.temp_low + self.temp * self.temp_step


def drop_repeats(a: Atoms) -> Atoms:
    """Without atoms that bear the name of the one before."""
    keep = np.concatenate([[True], a.atom[1:] != a.atom[:-1]])[: len(a.atom)]
    return Atoms(a.atom[keep], a.residue[keep], a.number[keep], a.serial[keep], a.coord[keep], a.temp[keep], a.chain)


def torsions(p: np.ndarray) -> np.ndarray:
    """Torsions, in degrees, of each four consecutive points of (..., n, 3); the format's series are of single precision."""
    d = np.diff(p.astype(np.float32), axis=-2)
    u = np.cross(d[..., :-1, :], d[..., 1:, :])
    with np.errstate(invalid="ignore", divide="ignore"):
        c = (u[..., :-1, :] * u[..., 1:, :]).sum(-1) / np.sqrt((u[..., :-1, :] ** 2).sum(-1) * (u[..., 1:, :] ** 2).sum(-1))
    size = np.where(np.isnan(c), 0.0, np.degrees(np.arccos(np.clip(np.nan_to_num(c), -1, 1))))
    side = (u[..., :-1, :] * np.cross(u[..., 1:, :], d[..., 1:-1, :])).sum(-1)
    return np.where(side < 0, -size, size)


def bond_angles(p: np.ndarray) -> np.ndarray:
    a, b = p[:-2] - p[1:-1], p[2:] - p[1:-1]
    return np.degrees(np.arccos(np.clip((a * b).sum(-1) / np.sqrt((a**2).sum(-1) * (b**2).sum(-1)), -1, 1)))


def _fit(x: np.ndarray, bins: int) -> tuple[float, float, np.ndarray]:
    """_fit_each of one stretch, which may be empty."""
    if not len(x):
        return 0.0, 0.0, np.zeros(0, np.int64)
    low, step, of = _fit_each(x[:, None], np.array([0]), np.array([len(x)]), np.array([bins]))
    return float(low[0, 0]), float(step[0, 0]), of[:, 0]


def anchor_indices(n: int, interval: int) -> np.ndarray:
    if interval < 1:
        raise EntryError("the anchor interval must be at least 1")
    inner = n // interval
    return np.append(np.arange(inner + 1) * (n // (inner + 1)), n - 1)


def _residue_starts(a: Atoms) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], a.number[1:] != a.number[:-1]]))


def encode(a: Atoms, title: str, interval: int = INTERVAL) -> bytes:
    """The entry of one fragment. Side-chain atoms that are missing count as the origin."""
    a = drop_repeats(a)
    if not len(a.atom):
        raise EntryError("no atoms")
    blobs, errors = encode_many(a, np.array([0, len(a.atom)]), [title], [a.chain], interval)
    if errors[0] is not None:
        raise EntryError(errors[0])
    return blobs[0]


@lru_cache(1)
def _slots() -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """A number for each atom name of the dictionary, and of each residue those of its side torsions' four atoms."""
    known = dictionary()
    number = {x: k for k, x in enumerate(dict.fromkeys(x for r in known.values() for x in r.atoms))}
    return number, {n: np.array([[number[x] for x in (*s.before, s.name)] for s in r.side], int).reshape(-1, 4) for n, r in known.items()}


def _numbered(names: np.ndarray, number: dict[str, int]) -> np.ndarray:
    """The number of each name, -1 where it has none."""
    found = pc.dictionary_encode(pa.array(names, pa.string(), from_pandas=True))
    of = np.array([*(number.get(x, -1) for x in found.dictionary.to_pylist()), -1])
    return of[pc.fill_null(found.indices, len(of) - 1).to_numpy(zero_copy_only=False)]


def _fit_each(x: np.ndarray, first: np.ndarray, counts: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least values and steps of the columns of x in stretches of rows, and bins, rounded half up, of each row; one bin where all values of a stretch are alike."""
    low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    least, most = low.astype(float), high.astype(float)
    flat = most <= least
    span = np.where(flat, 1.0, most - least)
    scaled = np.floor((x - np.repeat(low, counts, 0)) * np.repeat((bins / span).astype(x.dtype), counts, 0) + x.dtype.type(0.5))
    with np.errstate(invalid="ignore"):
        return least, np.where(flat, 0.0, span / bins), np.where(np.repeat(flat, counts, 0), 0, scaled.astype(np.int64))


def encode_many(a: Atoms, ends: np.ndarray, titles: list[str], chains: list[str | None], interval: int = INTERVAL) -> tuple[list[bytes | None], list[str | None]]:
    """Entries and errors of fragments that lie one after another in a, between ends; without atoms that repeat. Each step is one for all fragments."""
    number_of, torsions_of = _slots()
    known = dictionary()
    count = np.diff(ends)
    m, atoms = len(count), len(a.atom)
    of = np.repeat(np.arange(m), count)
    slot = _numbered(a.atom, number_of)
    place = np.full(len(number_of) + 1, -1)
    place[[number_of[x] for x in ("N", "CA", "C")]] = (0, 1, 2)
    turn = place[slot]
    bb = np.flatnonzero(turn >= 0)
    held = np.bincount(of[bb], minlength=m)
    within = np.arange(len(bb)) - np.repeat(np.cumsum(held) - held, held)
    broken = (held < 6) | (held % 3 > 0) | (np.bincount(of[bb], weights=turn[bb] != within % 3, minlength=m) > 0)
    opens = np.ones(atoms, bool)
    opens[1:] = (a.number[1:] != a.number[:-1]) | (of[1:] != of[:-1])
    residues = np.bincount(of[opens], minlength=m)
    code_of = {x: NAMES.index(x) for x in known}
    names = a.residue[opens]
    code = _numbered(names, code_of)
    first_residue = np.cumsum(residues) - residues
    errors: list[str | None] = [None] * m
    for k in range(m):
        n, begins = int(held[k]) // 3, a.number[ends[k]] if count[k] else 0
        own = slice(first_residue[k], first_residue[k] + residues[k])
        if not count[k]:
            errors[k] = "no atoms"
        elif broken[k]:
            errors[k] = "the backbone is not made of N, CA and C in turn"
        elif residues[k] != n:
            errors[k] = "residues and backbone do not match"
        elif interval < 1:
            errors[k] = "the anchor interval must be at least 1"
        elif n // interval + 2 > 255 or n > 65535 or count[k] > 65535 or not 0 <= begins <= 65535:
            errors[k] = "too large for the format"
        elif (unknown := code[own] < 0).any():
            errors[k] = f"unknown residue {min(map(str, names[own][unknown]))}"
    blobs: list[bytes | None] = [None] * m
    good = np.array([e is None for e in errors], bool)
    if not good.any():
        return blobs, errors

    # From here on the good fragments alone.
    which = np.flatnonzero(good)
    kept = good[of]
    slot, coord, opens = slot[kept], a.coord[kept].astype(float), opens[kept]
    bb = np.flatnonzero(turn[kept] >= 0)
    n, code = residues[which], code[np.repeat(good, residues)]
    total, last = int(n.sum()), np.cumsum(n) - 1
    begin = last - n + 1
    p = coord[bb]
    inner = np.ones(total, bool)
    inner[last] = False
    steps = n - 1
    twists = np.append(torsions(p), np.zeros(3, np.float32)).reshape(-1, 3)[inner].astype(np.float32)
    bends = np.append(bond_angles(p)[1:], np.zeros(3)).reshape(-1, 3)[inner]
    first = np.cumsum(steps) - steps
    word = np.zeros((total, 6), np.int64)
    # Columns as they come along the backbone: psi, omega, phi; CA-C-N, C-N-CA, N-CA-C.
    along = ("psi", "omega", "phi", "ca_c_n", "c_n_ca", "n_ca_c")
    bins = np.array([BINS[x] for x in along])
    fits = [_fit_each(x, first, steps, b) for x, b in ((twists, bins[:3]), (bends, bins[3:]))]
    word[inner] = np.concatenate([f[2] for f in fits], 1)
    stored = [along.index(x) for x in SERIES]
    low, step = (np.concatenate([f[k] for f in fits], 1)[:, stored] for k in (0, 1))

    # Side-chain torsions: of two atoms of one name the first counts.
    at = np.full((total, len(number_of)), len(coord))
    has = np.flatnonzero(slot >= 0)[::-1]
    at[(np.cumsum(opens) - 1)[has], slot[has]] = has
    sides = np.zeros(len(NAMES), int)
    for x, q in torsions_of.items():
        sides[code_of[x]] = len(q)
    n_side = sides[code]
    side_end = np.cumsum(n_side)
    quads = np.empty((int(side_end[-1]), 4), int)
    for x, q in torsions_of.items():
        own = np.flatnonzero(code == code_of[x])
        if len(q) and len(own):
            quads[((side_end - n_side)[own][:, None] + np.arange(len(q))).ravel()] = at[own][:, q].reshape(-1, 4)
    padded = np.vstack([coord, np.zeros((1, 3))])
    side = torsions(padded[quads])[:, 0] if len(quads) else np.zeros(0)
    side_bytes = np.floor((side + 180) * (255 / 360)).astype(np.int64).astype(np.uint8).tobytes()
    temp_low, temp_step, temp = _fit_each(a.temp[kept][bb][1::3].astype(float)[:, None], begin, n, np.array([255]))
    temp_bytes = temp.astype(np.uint8).tobytes()
    psi, omega, phi, *bent = word.T
    packed = np.stack([code << 3 | omega >> 8, omega & 255, psi >> 4, (psi & 15) << 4 | phi >> 8, phi & 255, *bent], 1).astype(np.uint8).tobytes()
    points = p.reshape(-1, 3, 3).astype("<f4")
    for j, k in enumerate(which.tolist()):
        b, e = int(begin[j]), int(last[j]) + 1
        anchors, name = anchor_indices(e - b, interval), titles[k].encode()
        end = ends[k + 1] - 1
        oxt = a.coord[end] if a.atom[end] == "OXT" else None
        s0, s1 = int(side_end[b] - n_side[b]), int(side_end[e - 1])
        letters = [LETTERS[c].encode() for c in (code[b], code[e - 1])]
        header = HEADER.pack(
            e - b, int(count[k]), int(a.number[ends[k]]), int(a.serial[ends[k]]) & 0xFFFF, len(anchors), (chains[k] or " ")[:1].encode(), s1 - s0, *letters, len(name), *low[j].tolist(), *step[j].tolist()
        )
        blobs[k] = b"".join(
            [
                MAGIC, header, anchors.astype("<i4").tobytes(), name, points[b + anchors].tobytes(),
                bytes([oxt is not None]) + np.asarray(oxt if oxt is not None else (0, 0, 0), "<f4").tobytes(),
                packed[8 * b : 8 * e], side_bytes[s0:s1], struct.pack("<2f", temp_low[j, 0], temp_step[j, 0]), temp_bytes[b:e],
            ]
        )
    return blobs, errors


def parse(blob: bytes, whole: bool = True) -> Entry:
    """The fields of an entry's bytes. Unless it has to be whole, its last series may be shorter than its header says."""
    if blob[:4] != MAGIC:
        raise EntryError("not an entry")
    if len(blob) < 4 + HEADER.size:
        raise EntryError("too short")
    n, n_atom, number, serial, n_anchor, chain, n_side, _, _, n_title, *floats = HEADER.unpack_from(blob, 4)
    at = 4 + HEADER.size
    need = 97 + 40 * n_anchor + n_title + 9 * n + n_side
    if len(blob) < (need if whole else 4 + HEADER.size + 40 * n_anchor + n_title + 13):
        raise EntryError("too short")

    def take(count: int, kind: str, unit: int = 1) -> np.ndarray:
        nonlocal at
        there = (len(blob) - at) // np.dtype(kind).itemsize // unit * unit
        out = np.frombuffer(blob, kind, min(count, max(there, 0)), min(at, len(blob)))
        at += out.nbytes
        return out

    anchors = take(n_anchor, "<i4").astype(np.int64)
    title = take(n_title, "u1").tobytes().decode("utf-8", "replace")
    coord = take(9 * n_anchor, "<f4").reshape(-1, 3, 3).astype(float)
    has_oxt = bool(take(1, "u1")[0])
    oxt = take(3, "<f4").astype(float)
    w = take(8 * n, "u1", 8).reshape(-1, 8).astype(np.int64)
    side = take(n_side, "u1").astype(np.int64)
    temp_low, temp_step = np.append(take(2, "<f4").astype(float), (0.0, 0.0))[:2]
    temp = take(n, "u1").astype(np.int64)
    bins = {"omega": (w[:, 0] & 7) << 8 | w[:, 1], "psi": w[:, 2] << 4 | w[:, 3] >> 4, "phi": (w[:, 3] & 15) << 8 | w[:, 4], "ca_c_n": w[:, 5], "c_n_ca": w[:, 6], "n_ca_c": w[:, 7]}
    if whole and (n < 2 or (np.diff(anchors) < 1).any() or not n_anchor or anchors[0] != 0 or anchors[-1] != n - 1):
        raise EntryError("anchors that do not fit the residues")
    return Entry(
        title, chain.decode("latin-1"), number, serial, n_atom, w[:, 0] >> 3, anchors, coord, oxt if has_oxt else None,
        np.array(floats[:6]), np.array(floats[6:]), bins, side, float(temp_low), float(temp_step), temp,
    )


def place(a: np.ndarray, b: np.ndarray, c: np.ndarray, length, angle, twist) -> np.ndarray:
    """Points at lengths, angles and torsions (degrees) from three points each."""
    axis = c - b
    axis = axis / np.sqrt((axis**2).sum(-1, keepdims=True))
    n = np.cross(b - a, axis)
    n = n / np.maximum(np.sqrt((n**2).sum(-1, keepdims=True)), 1e-30)
    m = np.cross(n, axis)
    theta, tau = np.radians(angle), np.radians(twist)
    x = np.stack([-length * np.cos(theta), length * np.cos(tau) * np.sin(theta), length * np.sin(tau) * np.sin(theta)], -1)
    return c + axis * x[..., :1] + m * x[..., 1:2] + n * x[..., 2:]


def _walk(start: np.ndarray, length: np.ndarray, angle: np.ndarray, twist: np.ndarray) -> np.ndarray:
    """Points from three first ones on, (m, 3, 3), by rows of (m, steps) lengths, angles and torsions: (m, 3 + steps, 3)."""
    out = np.empty((len(start), 3 + length.shape[1], 3))
    out[:, :3] = start
    for i in range(length.shape[1]):
        out[:, i + 3] = place(out[:, i], out[:, i + 1], out[:, i + 2], length[:, i], angle[:, i], twist[:, i])
    return out


def decode_backbones(entries: list[Entry]) -> list[np.ndarray]:
    """(residues, 3, 3) of each entry: N, CA and C. Lengths and angles come in order of placing: N, CA, C of the next residue.

    The k-th stretches between anchors of all entries are placed together, those of
    one length in one array.
    """
    series = []
    for e in entries:
        n = len(e.codes)
        length = np.tile([C_N, N_CA, CA_C], (n - 1, 1))
        length[[x == "PRO" for x in e.names[: n - 1]], 1] = PRO_N_CA
        twist = np.stack([e.series("psi"), e.series("omega"), e.series("phi")], 1)[: n - 1]
        bend = np.stack([e.series("ca_c_n"), e.series("c_n_ca"), e.series("n_ca_c")], 1)[: n - 1]
        series.append((twist, bend, length))
    out: list[list[np.ndarray]] = [[] for _ in entries]
    heads = [e.anchor_coord[0] for e in entries]
    # By the atom that comes before in reverse: N after CA, CA after C, C after the next N.
    back_length = np.array([C_N, N_CA, CA_C])
    for s in range(max((len(e.anchors) for e in entries), default=1) - 1):
        sizes: dict[int, list[int]] = {}
        for k, e in enumerate(entries):
            if s < len(e.anchors) - 1:
                sizes.setdefault(int(e.anchors[s + 1] - e.anchors[s]), []).append(k)
        for size, of in sizes.items():
            t, g, r = (np.stack([series[k][x][int(entries[k].anchors[s]) : int(entries[k].anchors[s + 1])].ravel() for k in of]) for x in range(3))
            forward = _walk(np.stack([heads[k] for k in of]), r, g, t)
            # Backwards from the next anchor, with the angles that the forward points have.
            a, b = forward[:, :-2] - forward[:, 1:-1], forward[:, 2:] - forward[:, 1:-1]
            angles = np.degrees(np.arccos(np.clip((a * b).sum(-1) / np.sqrt((a**2).sum(-1) * (b**2).sum(-1)), -1, 1)))[:, ::-1]
            kinds = np.tile([0, 1, 2], size + 1)[::-1][2 : 2 + 3 * size]
            ends = np.stack([entries[k].anchor_coord[s + 1][::-1] for k in of])
            back = _walk(ends, np.broadcast_to(back_length[kinds], t.shape), angles[:, 1 : 1 + t.shape[1]], t[:, ::-1])[:, ::-1]
            n = forward.shape[1]
            mixed = (forward * (n - np.arange(n))[:, None] + back * np.arange(n)[:, None]) / n
            for k, points in zip(of, mixed, strict=True):
                heads[k] = points[-3:]
                out[k].append(points if s == len(entries[k].anchors) - 2 else points[:-3])
    return [np.concatenate(x).reshape(-1, 3, 3) for x in out]


def decode(e: Entry, alternate: bool = False, number_oxt: bool = True) -> Atoms:
    """All atoms of an entry, numbered on from its first atom and residue."""
    return decode_many([e], alternate, number_oxt)[0]


def decode_many(entries: list[Entry], alternate: bool = False, number_oxt: bool = True) -> list[Atoms]:
    """All atoms of each entry, numbered on from its first atom and residue.

    number_oxt: the last oxygen has its residue's number; else the count of residues,
    as the format's first implementation has it.
    """
    known = dictionary()
    backbones = decode_backbones(entries)
    names = [x for e in entries for x in e.names]
    points = np.concatenate([*backbones, np.zeros((0, 3, 3))])
    side = np.concatenate([-180 + e.side * (360 / 255) for e in entries] or [np.zeros(0)])
    coords = with_side_chains(points, names, side, alternate)
    orders = {x: (known[x].alternate if alternate else known[x].atoms) for x in set(names)}
    out, at = [], 0
    for e in entries:
        n = len(e.codes)
        counts = [len(orders[x]) for x in e.names]
        atom = [a for x in e.names for a in orders[x]]
        coord, number = coords[at : at + n], np.repeat(e.first_number + np.arange(n), counts)
        residue, temp = np.repeat(np.array(e.names), counts), np.repeat(e.temperatures(), counts)
        if e.oxt is not None:
            atom, coord = [*atom, "OXT"], [*coord, e.oxt[None]]
            number, residue, temp = np.append(number, e.first_number + n - 1 if number_oxt else n), np.append(residue, e.names[-1]), np.append(temp, e.temperatures()[-1])
        at += n
        out.append(Atoms(np.array(atom), residue, number, e.first_serial + np.arange(len(atom)), np.concatenate(coord), temp, e.chain))
    return out


def with_side_chains(backbone: np.ndarray, names: list[str], twists: np.ndarray, alternate: bool = False) -> list[np.ndarray]:
    """Coordinates of the atoms of each residue, from its N, CA and C and its side chain's torsions, which follow one another.

    Residues of one kind grow their side chains together.
    """
    known = dictionary()
    first = np.cumsum([0, *(len(known[x].side) for x in names)])
    coords: list[np.ndarray] = [np.zeros((0, 3))] * len(names)
    kinds = np.array(names, object)
    for kind in set(names):
        of = np.flatnonzero(kinds == kind)
        held = {a: backbone[of, j] for j, a in enumerate(("N", "CA", "C"))}
        for j, s in enumerate(known[kind].side):
            p, q, r = (held[x] for x in s.before)
            held[s.name] = place(p, q, r, np.full(len(of), s.length), np.full(len(of), s.angle), twists[first[of] + j])
        order = known[kind].alternate if alternate else known[kind].atoms
        for k, xyz in zip(of.tolist(), np.stack([held[x] for x in order], 1), strict=True):
            coords[k] = xyz
    return coords


def decoded(blobs: list[bytes | None], alternate: bool = False, checked: bool = False) -> list[tuple[Entry | None, Atoms | None, str | None]]:
    """(entry, atoms, error) of each entry's bytes; checked: those that fail a check have what is said of it as error."""
    out: list[tuple] = []
    for b in blobs:
        try:
            if b is None:
                raise EntryError("no entry")
            if checked and (outcome := check(bytes(b))) != "SUCCESS":
                raise EntryError(outcome)
            e = parse(bytes(b))
            if len(e.side) != sum(len(dictionary()[x].side) for x in e.names):
                raise EntryError("side chains that do not fit the residues")
            out.append((e, None, None))
        except (EntryError, KeyError) as x:
            out.append((None, None, str(x) if isinstance(x, EntryError) else "unknown residue"))
    good = [k for k, x in enumerate(out) if x[0] is not None]
    for k, atoms in zip(good, decode_many([out[k][0] for k in good], alternate), strict=True):
        out[k] = (out[k][0], atoms, None)
    return out


def decimals(value: float, places: int) -> str:
    """Fixed decimals, a half away from zero, without a negative zero."""
    units = int(abs(value) * 10**places + 0.5)
    sign = "-" if value < 0 and units else ""
    return f"{sign}{units // 10**places}.{units % 10**places:0{places}d}"


_ATOM = "ATOM  %5d %-4s %3s %s%4d    %8.3f%8.3f%8.3f  1.00%6.2f          %2s  "


def _rounded(values: np.ndarray, scale: int) -> np.ndarray:
    """Values as decimals has them: rounded half away from zero to so many parts of one, without a negative zero."""
    units = np.floor(np.abs(values) * scale + 0.5)
    return np.where(units > 0, np.copysign(units, values), 0.0) / scale


def pdb_text(a: Atoms, title: str = "") -> str:
    """TITLE records where there is a title, ATOM records and a TER."""
    out = [f"TITLE     {title[:70]}"] if title else []
    out += [f"TITLE   {k // 70 + 1:2d} {title[k : k + 70]}" for k in range(70, len(title), 70)]
    number = [_rounded(v, k).tolist() for v, k in (*((v, 1000) for v in a.coord.T), (a.temp, 100))]
    for serial, atom, residue, n, *values in zip(a.serial.tolist(), a.atom.tolist(), a.residue.tolist(), a.number.tolist(), *number, strict=True):
        out.append(_ATOM % (serial, atom if len(atom) > 3 else " " + atom, residue, a.chain, n, *values, atom[0]))
    out.append(f"TER   {a.serial[-1] + 1:5d}      {a.residue[-1]:>3s} {a.chain}{a.number[-1]:4d}")
    return "\n".join(out) + "\n"


def features(e: Entry, a: Atoms | None = None) -> dict:
    """Angle series, sequence and coordinates of an entry, whose atoms may be decoded already. Series of an entry have a value for each residue."""
    a = decode(e) if a is None else a
    s = {k: e.series(k) for k in SERIES}
    return {
        "phi": s["phi"].tolist(), "psi": s["psi"].tolist(), "omega": s["omega"].tolist(),
        "torsion_angles": np.stack([s["psi"], s["omega"], s["phi"]], 1).ravel().tolist(),
        "bond_angles": np.stack([s["ca_c_n"], s["c_n_ca"], s["n_ca_c"]], 1).ravel().tolist(),
        "residues": "".join(LETTERS[c] for c in e.codes), "b_factors": e.temperatures().tolist(), "coordinates": a.coord.tolist(),
    }


def check(blob: bytes) -> str:
    """The outcome of a check: a code of report.VALIDITY. Bytes too short for a header and its anchors raise EntryError."""
    e = parse(blob, whole=False)
    n = HEADER.unpack_from(blob, 4)[0]
    known = dictionary()
    wanted = sum(len(known[x].side) for x in e.names if x in known)
    if len(e.bins["phi"]) != n:
        return "E_BACKBONE_COUNT_MISMATCH"
    if len(e.side) != wanted:
        return "E_SIDECHAIN_COUNT_MISMATCH"
    if len(e.temp) != n:
        return "E_TEMP_FACTOR_COUNT_MISMATCH"
    if not any(e.bins[k].any() for k in SERIES):
        return "E_EMPTY_BACKBONE_ANGLE"
    if not e.side.any():
        return "E_EMPTY_SIDECHAIN_ANGLE"
    return "SUCCESS" if e.temp.any() or e.temp_low else "E_EMPTY_TEMP_FACTOR"


# ---------------------------------------------------------------- over frames


def _atoms_of(frame: pd.DataFrame) -> Atoms:
    f = frame.sort_values("pos")
    return Atoms(*(f[c].to_numpy() for c in ("atom", "residue", "residue_index", "atom_index")), f[["x", "y", "z"]].to_numpy(), f["temp_factor"].to_numpy(), str(f["chain"].iloc[0]))


def compress(atoms: DataFrame, keys: list[str], title: str, interval: int = INTERVAL) -> DataFrame:
    """keys, blob, error: one entry for each group of atom rows, in order of pos; a group that cannot be one has an error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in atoms.select(*keys).schema.fields) + ", blob binary, error string"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *encoded(frame, str(frame[title].iloc[0]), interval))], columns=[*keys, "blob", "error"])

    return atoms.groupBy(*keys).applyInPandas(run, schema)


#: Columns of an atom that cutting texts into fragments and encoding takes, and atoms that are worked on together.
ATOM_FIELDS = ("record", "model", "chain", "residue", "residue_index", "icode", "atom", "atom_index", "x", "y", "z", "temp_factor")
AT_ONCE = 200_000


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers that are alike where values are, null ones among them."""
    return pc.fill_null(pc.dictionary_encode(values).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before, as the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
    return out


def _latest(marked: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The place of the last marked row up to each row since a row that begins a stretch; -1 where there is none."""
    place = np.arange(len(marked))
    last = np.maximum.accumulate(np.where(marked, place, -1)) if len(marked) else place
    return np.where(last >= np.maximum.accumulate(np.where(begins, place, 0)), last, -1) if len(marked) else place


def cut(text: np.ndarray, fields: dict[str, pa.Array], hetero: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of fragments in order, the ends of the fragments among them and each fragment's segment, of the records of texts that follow one another.

    As sources.structures.pdb_atoms and plans.structures.fragments have it: reading a text
    stops at END, models without a number are counted by their records, atoms of a residue
    come together within a run of one chain, an atom that bears the name of the one before
    goes, and so do rows of a run before its first N. A fragment ends where an N's number
    is more than one beyond the last N's.
    """
    record = fields["record"]
    given = pc.is_valid(fields["model"]).to_numpy(zero_copy_only=False)
    is_ = {x: pc.fill_null(pc.equal(record, x), False).to_numpy(zero_copy_only=False) for x in ("ATOM", "HETATM", "MODEL", "END")}
    base = np.maximum.accumulate(np.where(_changes(text), np.arange(len(text)), 0)) if len(text) else text
    marks = {x: is_[x] & ~given for x in ("MODEL", "END")}
    since = {x: np.cumsum(mark) - (np.cumsum(mark) - mark)[base] for x, mark in marks.items()}
    model = np.where(given, pc.fill_null(fields["model"], 0).to_numpy(zero_copy_only=False), np.maximum(since["MODEL"], 1))
    rows = np.flatnonzero((is_["ATOM"] | is_["HETATM"] | given) & (since["END"] == 0))
    rows = rows[np.lexsort((model[rows], text[rows]))]
    chain, atom = _codes(fields["chain"]), _codes(fields["atom"])
    number = pc.fill_null(fields["residue_index"].cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    known = pc.is_valid(fields["residue_index"]).to_numpy(zero_copy_only=False)

    # Atoms of a residue that comes up again in a run stand where it came up first.
    run = np.cumsum(_changes(text[rows], model[rows], chain[rows]))
    keys = [run, number[rows], known[rows], _codes(fields["icode"])[rows], _codes(fields["residue"])[rows]]
    block = np.cumsum(_changes(*keys)) - 1
    heads = np.flatnonzero(_changes(block)) if len(rows) else rows
    order = np.lexsort([k[heads] for k in keys[::-1]])
    group = np.cumsum(_changes(*(k[heads][order] for k in keys))) - 1
    first = np.full(len(heads), len(heads))
    np.minimum.at(first, group, order)
    of = np.empty(len(heads), int)
    of[order] = first[group]
    rows = rows[np.argsort(of[block], kind="stable")]

    if not hetero:
        rows = rows[is_["ATOM"][rows]]
    rows = rows[_changes(text[rows], model[rows], atom[rows])]
    is_n = pc.fill_null(pc.equal(fields["atom"], "N"), False).to_numpy(zero_copy_only=False)
    begins = _changes(text[rows], model[rows], chain[rows])
    opened = _latest(is_n[rows], begins) >= 0
    segment, rows = np.cumsum(begins)[opened], rows[opened]
    begins = _changes(segment)
    last = _latest(is_n[rows] & known[rows], begins)
    before = np.append(-1, last[:-1]) if len(rows) else last
    before[begins] = -1
    here = number[rows]
    gap = is_n[rows] & known[rows] & (before >= 0) & (here - here[before] > 1) if len(rows) else begins
    heads = np.flatnonzero(begins | gap)
    return rows, np.append(heads, len(rows)), segment[heads]


#: Of a fragment: its chain, its text's segments, the fragments of its segment, its number among them, and its entry.
MADE = pa.list_(pa.struct([("chain", pa.string()), ("segments", pa.int32()), ("pieces", pa.int32()), ("fragment", pa.int32()), ("blob", pa.binary()), ("error", pa.string()), ("seconds", pa.float64())]))


def _text_entries(b: pa.RecordBatch, parsed: Callable[[bytes, str], list[tuple]], interval: int, hetero: bool) -> list[list[dict]]:
    held = b.column("atoms")
    flat = held.flatten()
    text = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
    fields = {c: flat.field(c) for c in ATOM_FIELDS}
    rows = [(k, *r) for k, (c, kind) in enumerate(zip(b.column("content"), b.column("kind").to_pylist(), strict=True)) if c.is_valid for r in parsed(c.as_py(), kind)]
    if rows:
        of, *more = zip(*rows, strict=True)
        order = np.argsort(text := np.append(text, of), kind="stable")
        text, fields = text[order], {c: pa.concat_arrays([x, pa.array(v, x.type)]).take(pa.array(order)) for (c, x), v in zip(fields.items(), more, strict=True)}
    out: list[list[dict]] = [[] for _ in range(len(b))]
    rows, ends, segment = cut(text, fields, hetero)
    if not len(rows):
        return out
    began = time.perf_counter()
    atom, residue, number, serial, x, y, z, temp = (fields[c].take(pa.array(rows)).to_numpy(zero_copy_only=False) for c in ("atom", "residue", "residue_index", "atom_index", "x", "y", "z", "temp_factor"))
    of, chains, titles = text[rows[ends[:-1]]], fields["chain"].take(pa.array(rows[ends[:-1]])).to_pylist(), b.column("title").to_pylist()
    blobs, errors = encode_many(Atoms(atom, residue, number, serial, np.stack([x, y, z], 1), temp), ends, [titles[k] for k in of], chains, interval)
    seconds = (time.perf_counter() - began) * np.diff(ends) / len(rows)
    fresh = _changes(segment)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(segment)), 0))
    segments, pieces = np.bincount(of[fresh], minlength=len(b))[of], np.bincount(first, minlength=len(segment))[first]
    columns = (chains, segments.tolist(), pieces.tolist(), (np.arange(len(segment)) - first).tolist(), blobs, errors, seconds.tolist())
    for k, *values in zip(of.tolist(), *columns, strict=True):
        out[k].append(dict(zip((f.name for f in MADE.value_type), values, strict=True)))
    return out


def encoded_texts(texts: DataFrame, parsed: Callable[[bytes, str], list[tuple]], interval: int = INTERVAL, hetero: bool = False) -> DataFrame:
    """entry, name and made, the fragments of a text in order, of rows of a text each: entry, name, title and atoms, an array of structs of ATOM_FIELDS; or content and kind, which parsed makes tuples of ATOM_FIELDS of.

    seconds: a fragment's share, by atoms, of the time that it took to encode those that
    were encoded together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.add(pc.fill_null(pc.list_value_length(b.column("atoms")), 0), pc.divide(pc.fill_null(pc.binary_length(b.column("content")), 0), 80)).to_numpy(zero_copy_only=False)
            full = np.cumsum(sizes.astype(np.int64)) // AT_ONCE
            cuts = [0, *(np.flatnonzero(full[1:] != full[:-1]) + 1).tolist(), len(b)]
            for k, e in zip(cuts, cuts[1:], strict=False):
                some = b.slice(k, e - k)
                yield pa.RecordBatch.from_arrays([some.column("entry"), some.column("name"), pa.array(_text_entries(some, parsed, interval, hetero), MADE)], names=["entry", "name", "made"])

    made = "array<struct<chain: string, segments: int, pieces: int, fragment: int, blob: binary, error: string, seconds: double>>"
    return texts.select("entry", "name", "title", "atoms", "content", "kind").mapInArrow(run, f"entry string, name string, made {made}")


def encoded(frame: pd.DataFrame, title: str, interval: int) -> tuple[bytes | None, str | None]:
    """(entry, error) of a fragment's atom rows."""
    try:
        return encode(_atoms_of(frame), title, interval), None
    except EntryError as e:
        return None, str(e)


#: Entries that are decoded together.
TOGETHER = 256


def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for k in range(0, len(f), TOGETHER):
            yield f.iloc[k : k + TOGETHER]


def decompress(entries: DataFrame, name: str = "name", blob: str = "blob", alternate: bool = False) -> DataFrame:
    """name and its atoms: pos, atom_index, atom, residue, chain, residue_index, x, y, z, temp_factor, error.

    Bytes that are no whole entry give one row, with an error and no atom.
    """
    schema = "name string, pos long, atom_index int, atom string, residue string, chain string, residue_index int, x double, y double, z double, temp_factor double, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), TOGETHER):
                yield _atom_rows(b.slice(k, TOGETHER), alternate)

    return entries.select(F.col(name).alias("name"), F.col(blob).alias("blob")).mapInArrow(run, schema)


def _atom_rows(b: pa.RecordBatch, alternate: bool) -> pa.RecordBatch:
    """A row for each atom of the entries of a batch, and for each entry with an error; columns are made for all of them at once."""
    found = decoded(b.column("blob").to_pylist(), alternate)
    none = Atoms(*(np.array([x]) for x in ("", "", 0, 0)), np.zeros((1, 3)), np.zeros(1), "")  # a row that is made null
    atoms = [none if a is None else a for _, a, _ in found]
    counts = np.array([len(a.atom) for a in atoms], int)
    of = pa.array(np.repeat(np.arange(len(b)), counts))
    missing = np.repeat(np.array([a is None for _, a, _ in found], bool), counts)
    joined = {c: np.concatenate([getattr(a, c) for a in atoms] or [np.zeros(0)]) for c in ("serial", "atom", "residue", "number", "temp")}
    xyz = np.concatenate([np.zeros((0, 3)), *(a.coord for a in atoms)])
    pos = np.arange(len(missing)) - np.repeat(np.cumsum(counts) - counts, counts)
    chain = pa.array([a.chain for a in atoms], pa.string()).take(of)
    kinds = ((pos, pa.int64()), (joined["serial"].astype(np.int32), pa.int32()), (joined["atom"], pa.string()), (joined["residue"], pa.string()), (chain, None), (joined["number"].astype(np.int32), pa.int32()))
    # Coordinates that an entry does not have are null.
    columns = [v if t is None else pa.array(v, t, from_pandas=True) for v, t in (*kinds, *((v, pa.float64()) for v in (*xyz.T, joined["temp"])))]
    if missing.any():
        columns = [pc.if_else(pa.array(missing), pa.scalar(None, c.type), c) for c in columns]
    names = ["name", "pos", "atom_index", "atom", "residue", "chain", "residue_index", "x", "y", "z", "temp_factor", "error"]
    return pa.RecordBatch.from_arrays([b.column("name").take(of), *columns, pa.array([x for _, _, x in found], pa.string()).take(of)], names=names)


def texts(entries: DataFrame, alternate: bool = False, titles: bool = False, checked: bool = False) -> DataFrame:
    """entries without blob, with text and error: the PDB text of each entry, one row for each."""
    kept = [f for f in entries.schema.fields if f.name not in ("blob", "text", "error")]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, error string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in together(frames):
            found = decoded(f["blob"].tolist(), alternate, checked)
            out = f[names].copy()
            out["text"] = [None if a is None else pdb_text(a, e.title if titles else "") for e, a, _ in found]
            out["error"] = [x[2] for x in found]
            yield out

    done = entries.select(*names, "blob").mapInPandas(run, schema)
    return done.withColumn("error", F.coalesce(validity_message(F.col("error")), "error"))


def extract(entries: DataFrame, name: str = "name", blob: str = "blob") -> DataFrame:
    """name, title, n_residue, sequence, temps (array) and outcome of each entry; bytes that are none have an error as outcome."""
    schema = "name string, title string, n_residue int, sequence string, temps array<double>, outcome string, first_residue string, last_residue string, n_side long"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for n, b in zip(f["name"], f["blob"], strict=True):
                try:
                    if b is None:
                        raise EntryError("no entry")
                    outcome = check(bytes(b))
                    e = parse(bytes(b), whole=outcome == "SUCCESS")
                    letters = "".join(LETTERS[c] if c < len(LETTERS) else "X" for c in e.codes)
                    rows.append((n, e.title, len(e.codes), letters, e.temperatures().tolist(), outcome, letters[:1], letters[-1:], len(e.side)))
                except EntryError as x:
                    rows.append((n, None, None, None, None, str(x), None, None, None))
            yield pd.DataFrame(rows, columns=columns).astype({"n_residue": "Int32", "n_side": "Int64"})

    return entries.select(F.col(name).alias("name"), F.col(blob).alias("blob")).mapInPandas(run, schema)
