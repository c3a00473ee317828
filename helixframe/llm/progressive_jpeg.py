"""Progressive JPEG in numpy: scans into coefficients, coefficients into RGB tensors.

Many images are decoded at once. A lane is one restart interval of one scan; all
lanes of alike scans advance together, one Huffman symbol a step, and write into
one array of coefficients. Spectral selection and successive approximation, first
passes and refinements, are handled for DC and AC; then come the inverse
transform, chroma upsampling and colour conversion.

A payload of bytes is stored without loss as quantised coefficients, the format's
own unit: a byte of 128 or more is itself, a lesser one is less 255, so that each
has eight magnitude bits, and zero never stands for a byte.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .trie_counts import slices

UNIT, RESTART = 576, 4
#: Payload bytes that are coded at once.
SLICE = 2 << 20

# Fixed values of the format: the zigzag order of an 8 x 8 block.
ZIGZAG = np.array(
    [
        0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
        35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
    ]
)

#: The Huffman tables that we write, as (lengths of 1 to 16 bits, symbols): DC sizes in four bits each; for AC
#: one bit for a coefficient of seven magnitude bits, nine for all else.
DC_TABLE = ([0, 0, 0, 12, *[0] * 12], list(range(12)))
_AC_REST = [r << 4 | s for r in range(16) for s in range(11) if (r, s) != (0, 7)]
AC_TABLE = ([1, 0, 0, 0, 0, 0, 0, 0, len(_AC_REST), *[0] * 7], [0x07, *_AC_REST])

#: Components in scan, first and last coefficient, earlier and present bit position.
SCANS = [
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0),
]


def huffman_codes(lengths: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) by symbol."""
    code, k = 0, 0
    codes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for size, n in enumerate(lengths, 1):
        for s in symbols[k : k + n]:
            codes[s], bits[s] = code, size
            code += 1
        k += n
        code <<= 1
    return codes, bits


def huffman_lookup(lengths: list[int], symbols: list[int]) -> np.ndarray:
    """symbol << 8 | bits for each word of 16 bits that begins with the symbol's code."""
    out = np.zeros(1 << 16, np.int64)
    codes, bits = huffman_codes(lengths, symbols)
    for s in symbols:
        out[codes[s] << (16 - bits[s]) : (codes[s] + 1) << (16 - bits[s])] = s << 8 | bits[s]
    return out


def _grid(mcus: int) -> tuple[int, int]:
    wide = max(1, int(np.ceil(np.sqrt(mcus))))
    return wide, max(1, -(-mcus // wide))


# ---------------------------------------------------------------- encoding


#: Magnitude bits of values from -2048 to 2047.
_SIZES = np.array([int(abs(v)).bit_length() for v in range(-2048, 2048)])


def _size_of(v: np.ndarray) -> np.ndarray:
    return _SIZES[v + 2048]


@lru_cache(256)
def _raster(wide: int, high: int) -> np.ndarray:
    """Places, among blocks in order of MCU, of the luma blocks in raster order."""
    y, x = np.mgrid[0 : 2 * high, 0 : 2 * wide]
    return (((y >> 1) * wide + (x >> 1)) * 6 + (y & 1) * 2 + (x & 1)).ravel()


def _pack(value: np.ndarray, bits: np.ndarray, interval: np.ndarray, intervals: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of codes in order, intervals padded with ones, bytes of ones stuffed and restart markers set.

    owner: the image of each interval. Also returns where each image's bytes begin, and the end.
    """
    each = np.bincount(interval, bits, intervals).astype(np.int64)
    size = np.maximum(-(-each // 8), 1)
    base = np.cumsum(size) - size
    first = np.cumsum(bits) - bits
    start = first + (base * 8 - np.cumsum(each) + each)[interval]
    if not bits.all():
        used = bits > 0
        value, bits, start = value[used], bits[used], start[used]
    total = int(size.sum())
    word = start >> 5
    placed = value.astype(np.uint64) << (64 - (start & 31) - bits).astype(np.uint64)
    words = np.zeros(total // 4 + 3, np.uint64)
    if len(word):
        lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[lead]] = np.add.reduceat(placed, lead)
    out32 = (words >> np.uint64(32)).astype(np.uint32)
    out32[1:] += (words[:-1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    raw = out32.astype(">u4").view(np.uint8)[:total]
    raw[base + size - 1] |= ((1 << size * 8 - each) - 1).astype(np.uint8)

    full = raw == 0xFF
    extra = full.astype(np.int64)
    ends = base + size - 1
    followed = np.concatenate([owner[1:] == owner[:-1], [False]])
    extra[ends[followed]] += 2
    at = np.arange(total) + np.cumsum(extra) - extra
    out = np.zeros(total + int(extra.sum()), np.uint8)
    out[at] = raw
    mark = at[ends[followed]] + full[ends[followed]] + 1
    opening = np.concatenate([[True], owner[1:] != owner[:-1]])
    number = np.arange(intervals) - np.flatnonzero(opening)[np.cumsum(opening) - 1]
    out[mark] = 0xFF
    out[mark + 1] = 0xD0 + number[followed] % 8
    return out, np.append(at[base[opening]], len(out))


def _first_pass(x: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of an AC first pass: (value, bits, interval) in order."""
    codes, sizes = huffman_codes(*AC_TABLE)
    width = x.shape[1]
    b, k = np.nonzero(x)
    v = x[x != 0].astype(np.int64)
    fresh = np.concatenate([[True], b[1:] != b[:-1]])[: len(b)]
    run = k - np.where(fresh, -1, np.concatenate([[0], k[:-1]])[: len(k)]) - 1
    size = _size_of(v)
    symbol = (run & 15) << 4 | size
    magnitude = np.where(v > 0, v, v + (np.int64(1) << size) - 1)
    value, bits, where = codes[symbol] << size | magnitude, sizes[symbol] + size, interval[b]
    last = np.full(len(x), -1)
    last[b] = k
    upto = np.cumsum(np.bincount(b, minlength=len(x)))  # codes up to the end of each block
    if (run > 15).any():
        far = np.repeat(np.flatnonzero(run > 15), run[run > 15] >> 4)
        value, bits, where = (np.insert(c, far, e) for c, e in ((value, codes[0xF0]), (bits, sizes[0xF0]), (where, where[far])))
        upto += np.cumsum(np.bincount(b[far], minlength=len(x)))
    tail = last < width - 1
    if tail.any():
        goes_on = np.zeros(len(x), bool)
        goes_on[1:] = tail[:-1] & (last[1:] < 0) & (interval[1:] == interval[:-1])
        begins = tail & ~goes_on
        length = np.bincount(np.cumsum(begins)[tail] - 1)
        n = np.floor(np.log2(length)).astype(np.int64)
        at = np.flatnonzero(begins)
        value, bits, where = (np.insert(c, upto[at], e) for c, e in ((value, codes[n << 4] << n | (length - (np.int64(1) << n))), (bits, sizes[n << 4] + n), (where, interval[at])))
    return value, bits, where


def _refinement(x: np.ndarray, interval: np.ndarray, intervals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of an AC refinement in which no coefficient turns non-zero: one end-of-band run an interval, then correction bits."""
    codes, sizes = huffman_codes(*AC_TABLE)
    blocks = np.bincount(interval, minlength=intervals)
    n = np.floor(np.log2(blocks)).astype(np.int64)
    head = (codes[n << 4] << n | (blocks - (np.int64(1) << n)), sizes[n << 4] + n)
    there = (x != 0).astype(np.int64)
    bit = (np.abs(x) & 1).astype(np.int64)
    groups = range(0, x.shape[1], 21)
    value, bits = (np.zeros((len(x), len(groups)), np.int64) for _ in range(2))
    for g, k in enumerate(groups):
        for c in range(k, min(k + 21, x.shape[1])):
            value[:, g] = value[:, g] << there[:, c] | bit[:, c]
            bits[:, g] += there[:, c]
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]]) * len(groups)
    where = np.repeat(interval, len(groups))
    return np.insert(value.ravel(), first, head[0]), np.insert(bits.ravel(), first, head[1]), np.insert(where, first, np.arange(intervals))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _tables() -> bytes:
    quantiser = _segment(0xDB, b"\0" + b"\1" * 64)
    dc = _segment(0xC4, b"\x00" + bytes(DC_TABLE[0]) + bytes(DC_TABLE[1]))
    ac = _segment(0xC4, b"\x10" + bytes(AC_TABLE[0]) + bytes(AC_TABLE[1]))
    return quantiser + dc + ac + _segment(0xDD, RESTART.to_bytes(2, "big"))


def encode(coefficients: list[tuple[np.ndarray, int, int]]) -> list[bytes]:
    """Progressive streams of images (coefficients, MCUs across, MCUs down), 4:2:0, quantisers all one.

    coefficients: (MCUs, 6, 64) in zigzag order, the blocks of an MCU in scan order;
    magnitudes up to 1023, in AC none of one.
    """
    counts = np.array([len(c) for c, _, _ in coefficients])
    mcus = np.concatenate([c for c, _, _ in coefficients])
    image = np.repeat(np.arange(len(counts)), counts)
    # Luma blocks in raster order of the whole image, as scans of one component have them.
    raster = [_raster(wide, high) + base * 6 for base, (_, wide, high) in zip(np.cumsum(counts) - counts, coefficients, strict=True)]
    luma = mcus.reshape(-1, 64)[np.concatenate(raster)]
    planes = {0: (luma, np.repeat(np.arange(len(counts)), counts * 4)), 1: (mcus[:, 4], image), 2: (mcus[:, 5], image)}

    def intervals(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each unit, and the image of each interval."""
        opening = np.concatenate([[True], owner[1:] != owner[:-1]])
        within = np.arange(len(owner)) - np.flatnonzero(opening)[np.cumsum(opening) - 1]
        starts = within % RESTART == 0
        return np.cumsum(starts) - 1, owner[starts]

    parts: list[list[bytes]] = [[] for _ in counts]
    for components, low, high, before, now in SCANS:
        if low == 0:
            of, owner = intervals(image)
            unit = np.repeat(of, 6)
            if before:
                value, bits, where = mcus[:, :, 0].ravel().astype(np.int64) & 1, np.ones(len(unit), np.int64), unit
            else:
                dc = mcus[:, :, 0].astype(np.int64) >> now
                diff = np.empty_like(dc)
                fresh = np.concatenate([[True], of[1:] != of[:-1]])[:, None]
                diff[:, 1:4] = dc[:, 1:4] - dc[:, :3]
                for k, prev in ((0, 3), (4, 4), (5, 5)):
                    diff[:, k] = dc[:, k] - np.where(fresh[:, 0], 0, np.concatenate([[0], dc[:-1, prev]]))
                diff = diff.ravel()
                codes, sizes = huffman_codes(*DC_TABLE)
                size = _size_of(diff)
                value = codes[size] << size | np.where(diff > 0, diff, diff + (np.int64(1) << size) - 1)
                bits, where = sizes[size] + size, unit
        else:
            x, owner_of_block = planes[components[0]]
            of, owner = intervals(owner_of_block)
            band = x[:, low : high + 1]
            if before:
                value, bits, where = _refinement(band, of, len(owner))
            else:
                value, bits, where = _first_pass((band + ((1 << now) - 1) * (band < 0).astype(np.int16)) >> now, of)
        data, at = _pack(value, bits, where, len(owner), owner)
        head = _segment(0xDA, bytes([len(components), *(x for c in components for x in (c + 1, 0)), low, high, before << 4 | now]))
        data = data.tobytes()
        for k in range(len(counts)):
            parts[k] += [head, data[at[k] : at[k + 1]]]
    tables = _tables()
    out = []
    for k, (_, wide, high) in enumerate(coefficients):
        frame = _segment(0xC2, b"\x08" + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        out.append(b"\xff\xd8" + frame + tables + b"".join(parts[k]) + b"\xff\xd9")
    return out


# ---------------------------------------------------------------- decoding


class _Component:
    def __init__(self, ident: int, h: int, v: int, table: int) -> None:
        self.ident, self.h, self.v, self.table = ident, h, v, table
        self.base = self.stride = self.wide = self.high = self.rows = 0


class Image:
    """The frame of one stream."""

    def __init__(self, width: int, height: int, components: list[_Component]) -> None:
        self.width, self.height, self.components = width, height, components
        self.h, self.v = max(c.h for c in components), max(c.v for c in components)
        self.across, self.down = -(-width // (8 * self.h)), -(-height // (8 * self.v))
        self.quantisers: dict[int, np.ndarray] = {}
        for c in components:
            c.stride, c.rows = self.across * c.h, self.down * c.v
            c.wide, c.high = -(-(-(-width * c.h // self.h)) // 8), -(-(-(-height * c.v // self.v)) // 8)


class _Lanes:
    """Restart intervals of alike scans: where their bits begin and the blocks they fill, in order."""

    def __init__(self) -> None:
        self.start: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.component: list[np.ndarray] = []
        self.total = 0

    def add(self, start: np.ndarray, blocks: np.ndarray, per: int, component: np.ndarray | None = None) -> None:
        first = np.arange(len(start)) * per
        self.start.append(start)
        self.first.append(first + self.total)
        self.count.append(np.minimum(per, len(blocks) - first))
        self.blocks.append(blocks)
        if component is not None:
            self.component.append(component)
        self.total += len(blocks)


@lru_cache(256)
def _units(across: int, down: int, components: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in order, the component of each, and the blocks of a unit of restart intervals."""
    if len(components) == 1:
        _, _, base, stride, wide, high = components[0]
        rows, columns = np.divmod(np.arange(wide * high), wide)
        return base + rows * stride + columns, np.zeros(wide * high, np.int64), 1
    my, mx = np.divmod(np.arange(across * down), across)
    units = np.stack([base + (my * v + dy) * stride + mx * h + dx for h, v, base, stride, _, _ in components for dy in range(v) for dx in range(h)], 1)
    component = np.concatenate([np.full(c[0] * c[1], k) for k, c in enumerate(components)])
    return units.ravel(), np.tile(component, across * down), units.shape[1]


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def decode(streams: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images' frames and one array of coefficients (blocks, 64) in zigzag order that all of them share."""
    joined = b"".join(streams) + b"\0" * 16
    data = np.frombuffer(joined, np.uint8)
    ones = np.flatnonzero(data[:-1] == 0xFF)
    stuffed = ones[data[ones + 1] == 0] + 1
    marks = ones[(data[ones + 1] != 0) & (data[ones + 1] != 0xFF)]
    codes = data[marks + 1]
    keep = np.ones(len(data), bool)
    keep[stuffed] = False
    plain = data[keep]
    # At each byte, seven bytes from there on as one number.
    word = np.zeros(len(plain), np.int64)
    for k in range(7):
        word[:-6] |= plain[k : len(plain) - 6 + k].astype(np.int64) << 8 * (6 - k)
    dropped = np.searchsorted(stuffed, marks)
    after_mark = (marks + 2 - dropped) * 8
    restart = (codes >= 0xD0) & (codes <= 0xD7)
    others = np.flatnonzero(~restart).tolist()
    places = marks.tolist()

    images: list[Image] = []
    groups: dict[tuple, _Lanes] = defaultdict(_Lanes)
    order: dict[int, list[tuple]] = defaultdict(list)
    lookups: dict[bytes, np.ndarray] = {}
    blocks = 0
    begin = 0
    for stream in streams:
        tables: dict[int, bytes] = {}
        quantisers: dict[int, np.ndarray] = {}
        interval, image, at, level = 0, None, begin + 2, 0
        while True:
            if joined[at] != 0xFF:
                raise ValueError("no marker where one is due")
            code = joined[at + 1]
            if code == 0xFF:
                at += 1
                continue
            if code == 0xD9:
                break
            size = int.from_bytes(joined[at + 2 : at + 4], "big")
            body = joined[at + 4 : at + 2 + size]
            if code == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                    body = body[1 + 64 * wide :]
            elif code == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = body[1 : 17 + n]
                    if tables[body[0]] not in lookups:
                        lookups[tables[body[0]]] = huffman_lookup(list(body[1:17]), list(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif code == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif code == 0xC2:
                parts = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
                image = Image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), parts)
                image.quantisers = quantisers
                for c in parts:
                    c.base = blocks
                    blocks += c.stride * c.rows
            elif code in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive stream")
            elif code == 0xDA:
                n = body[0]
                chosen = [next(c for c in image.components if c.ident == body[1 + 2 * k]) for k in range(n)]
                picks = [body[2 + 2 * k] for k in range(n)]
                low, high, bits = body[1 + 2 * n : 4 + 2 * n]
                before, now = bits >> 4, bits & 15
                here = bisect_left(places, at)
                after = others[bisect_right(others, here)]
                starts = np.concatenate([[(at + 2 + size - dropped[here]) * 8], after_mark[here + 1 : after]])
                units, component, each = _units(image.across, image.down, tuple((c.h, c.v, c.base - image.components[0].base, c.stride, c.wide, c.high) for c in chosen))
                units = units + image.components[0].base
                names = tuple(tables.get(p >> 4, b"") for p in picks) if low == 0 else (tables[0x10 | picks[0] & 15],)
                key = (level, low, high, before, now, names if not (low == 0 and before) else ())
                if key not in groups:
                    order[level].append(key)
                groups[key].add(starts, units, interval * each if interval else len(units), component)
                level += 1
                at = places[after]
                continue
            at += 2 + size
        images.append(image)
        begin += len(stream)

    out = np.zeros((blocks, 64), np.int16)
    for level in sorted(order):
        for key in order[level]:
            _, low, high, before, now, names = key
            lanes = groups[key]
            start, first, count, units, component = (np.concatenate(x) for x in (lanes.start, lanes.first, lanes.count, lanes.blocks, lanes.component))
            if low == 0 and before:
                _dc_refine(out, plain, start, first, count, units, now)
            elif low == 0:
                _dc_first(out, word, np.stack([lookups[x] for x in names]), start, first, count, units, component, now)
            elif before:
                _ac_refine(out, plain, word, lookups[names[0]], start, first, count, units, low, high, now)
            else:
                _ac_first(out, word, lookups[names[0]], start, first, count, units, low, high, now)
    return images, out


def _peek(word: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return (word[at >> 3] >> (56 - (at & 7) - n)) & ((1 << n) - 1)


def _dc_first(out, word, lookups, start, first, count, units, component, now) -> None:
    at, lane = start.copy(), np.arange(len(start))
    before = np.zeros((len(start), len(lookups)), np.int64)
    for step in range(int(count.max(initial=0))):
        lane = lane[step < count[lane]]
        unit = first[lane] + step
        c = component[unit]
        found = lookups[c, _peek(word, at[lane], 16)]
        at[lane] += found & 255
        size = found >> 8
        diff = _extend(_peek(word, at[lane], size), size)
        at[lane] += size
        before[lane, c] += diff
        out[units[unit], 0] = before[lane, c] << now


def _dc_refine(out, plain, start, first, count, units, now) -> None:
    lane = np.repeat(np.arange(len(start)), count)
    step = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
    at = start[lane] + step
    out[units[first[lane] + step], 0] |= ((plain[at >> 3].astype(np.int64) >> (7 - (at & 7))) & 1).astype(np.int16) << now


def _ac_first(out, word, lookup, start, first, count, units, low, high, now) -> None:
    # Of each code at once: bits it takes with what follows it, of these the magnitude or run bits, the run, and whether it codes a coefficient.
    bits_of, symbol = lookup & 255, lookup >> 8
    run_of, size_of = symbol >> 4, symbol & 15
    extra_of = np.where(size_of > 0, size_of, np.where(run_of < 15, run_of, 0))
    packed = (bits_of + extra_of) | extra_of << 8 | run_of << 12 | (size_of > 0) << 16
    flat = out.ravel()
    at, unit, end = start.copy(), first.copy(), first + count
    k, row = np.full(len(at), low), units[first] << 6
    while len(at):
        w, shift = word[at >> 3], at & 7
        found = packed[(w >> (40 - shift)) & 0xFFFF]
        taken, extra, run = found & 255, (found >> 8) & 15, (found >> 12) & 15
        mask = (1 << extra) - 1
        bits = (w >> (56 - shift - taken)) & mask
        at += taken
        place = k + run
        coded = found >> 16 > 0
        value = np.where(bits > mask >> 1, bits, bits - mask) << now
        if coded.all():
            flat[row + place] = value
            k = place + 1
            done = k > high
            if not done.any():
                continue
            unit += done
        else:
            flat[(row + place)[coded]] = value[coded]
            ends = ~coded & (run < 15)
            k = np.where(ends, high + 1, place + 1)
            done = k > high
            unit += np.where(ends, (1 << np.where(ends, run, 0)) + bits, done)
        k[done] = low
        going = unit < end
        if not going.all():
            at, unit, end, k = at[going], unit[going], end[going], k[going]
        row = units[unit] << 6


def _ac_refine(out, plain, word, lookup, start, first, count, units, low, high, now) -> None:
    at, unit, end = start.copy(), first.copy(), first + count
    k, left = np.full(len(at), low), np.zeros(len(at), np.int64)
    columns = np.arange(low, high + 1)
    step = np.int16(1 << now)
    while len(at):
        read = left == 0
        found = lookup[_peek(word, at, 16)]
        at = at + np.where(read, found & 255, 0)
        run, size = np.where(read, found >> 12, 0), np.where(read, (found >> 8) & 15, 0)
        ends = read & (size == 0) & (run < 15)
        extra = np.where(ends, run, np.where(size > 0, 1, 0))
        bits = _peek(word, at, extra)
        at += extra
        left = np.where(ends, (1 << np.where(ends, run, 0)) + bits, left)
        whole = left > 0
        blocks = units[unit]
        rows = out[blocks, low : high + 1]
        span = rows != 0
        stop = None
        if not (whole.all() and (k == low).all()):
            # The place of the zero that follows so many others, up to which non-zero ones are corrected.
            ahead = columns >= k[:, None]
            reach = np.cumsum(~span & ahead, 1, dtype=np.int16) > run[:, None]
            stop = np.where(reach.any(1), reach.argmax(1) + low, high + 1)
            stop = np.where(whole, high + 1, stop)
            span &= ahead & (columns < stop[:, None])
        rank = np.cumsum(span, 1, dtype=np.int32)
        place = rank + (at - 1)[:, None]
        bit = (plain[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
        bit &= span
        rows += np.where(rows < 0, -step, step) * bit.astype(np.int16)
        at += rank[:, -1]
        if stop is None:
            k[:] = high + 1
        else:
            put = np.flatnonzero((size > 0) & (stop <= high))
            rows[put, stop[put] - low] = np.where(bits[put] == 1, step, -step)
            k = np.where(whole, high + 1, stop + 1)
        out[blocks, low : high + 1] = rows
        done = k > high
        left = np.where(whole, left - 1, left)
        unit = unit + done
        k[done] = low
        going = unit < end
        if not going.all():
            at, unit, end, k, left = at[going], unit[going], end[going], k[going], left[going]


# ---------------------------------------------------------------- samples

#: The inverse transform with whole numbers of this many fraction bits: sums are exact in double precision, in any order.
FRACTION = 13
_u = np.arange(8)
_BASIS = np.round(np.cos((2 * _u[:, None] + 1) * _u[None, :] * np.pi / 16) * np.where(_u == 0, np.sqrt(1 / 8), 0.5)[None, :] * (1 << FRACTION))


def inverse_transform(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of blocks of zigzag coefficients: (blocks, 8, 8)."""
    grid = np.zeros((len(coefficients), 64))
    grid[:, ZIGZAG] = coefficients * quantiser
    rows = grid.reshape(-1, 8) @ _BASIS.T
    turned = np.ascontiguousarray(rows.reshape(-1, 8, 8).transpose(0, 2, 1)).reshape(-1, 8) @ _BASIS.T
    samples = np.floor(turned / (1 << 2 * FRACTION) + 128.5)
    return np.clip(samples, 0, 255).astype(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1)


def _round(x: np.ndarray) -> np.ndarray:
    return np.clip((x + (1 << 15)) >> 16, 0, 255).astype(np.uint8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """RGB of full-range planes of one shape, in whole numbers of sixteen fraction bits."""
    y, cb, cr = y.astype(np.int32) << 16, cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    return np.stack([_round(y + 91881 * cr), _round(y - 22554 * cb - 46802 * cr), _round(y + 116130 * cb)], -1)


def samples_of(images: list[Image], coefficients: np.ndarray) -> np.ndarray:
    """Samples of all blocks of all images: (blocks, 8, 8); blocks of one quantiser are transformed together."""
    by: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for image in images:
        for c in image.components:
            by[image.quantisers[c.table].tobytes()].append((c.base, c.stride * c.rows))
    if len(by) == 1:
        return inverse_transform(coefficients, np.frombuffer(next(iter(by)), np.int64))
    out = np.zeros((len(coefficients), 8, 8), np.uint8)
    for key, runs in by.items():
        rows = np.concatenate([np.arange(base, base + n) for base, n in runs])
        out[rows] = inverse_transform(coefficients[rows], np.frombuffer(key, np.int64))
    return out


def rgb_tensor(image: Image, samples: np.ndarray) -> np.ndarray:
    """The image in full resolution: (height, width, 3); a single component gives grey."""
    planes = []
    for c in image.components:
        p = samples[c.base : c.base + c.stride * c.rows].reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
        if (image.v, image.h) != (c.v, c.h):
            p = p.repeat(image.v // c.v, 0).repeat(image.h // c.h, 1)
        planes.append(p[: image.height, : image.width])
    if len(planes) == 1:
        return np.stack([planes[0]] * 3, -1)
    return to_rgb(*planes[:3])


# ---------------------------------------------------------------- payloads


def payload_of(text: bytes | None, unit: int = UNIT) -> bytes:
    """The text filled up with bytes 255 to a positive multiple of the unit."""
    text = text or b""
    return text + b"\xff" * (max(1, -(-len(text) // unit)) * unit - len(text))


def store(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload, whose bytes are its coefficients in order of MCU, block and zigzag."""
    images = []
    for p in payloads:
        v = np.frombuffer(p, np.uint8).astype(np.int16)
        wide, high = _grid(-(-len(v) // 384))
        mcus = np.zeros(wide * high * 384, np.int16)
        mcus[: len(v)] = np.where(v >= 128, v, v - 255)
        images.append((mcus.reshape(-1, 6, 64), wide, high))
    return encode(images)


def read_back(image: Image, coefficients: np.ndarray) -> bytes:
    """The payload of a stored stream: its coefficients up to the first that is zero."""
    base = image.components[0].base
    units, _, _ = _units(image.across, image.down, tuple((c.h, c.v, c.base - base, c.stride, c.wide, c.high) for c in image.components))
    v = coefficients[units + base].ravel()
    v = v[v != 0]
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


def feature_of(rgb: np.ndarray) -> str:
    """Size, channel sums and a histogram of eight levels for each channel."""
    flat = rgb.reshape(-1, 3)
    levels = np.bincount((np.arange(3, dtype=np.uint8) * 8 + (flat >> 5)).ravel(), minlength=24).reshape(3, 8).tolist()
    return f"{rgb.shape[1]}x{rgb.shape[0]} sum={','.join(map(str, flat.sum(0, dtype=np.int64)))} hist={';'.join(','.join(map(str, x)) for x in levels)}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, tensors: bool = True) -> DataFrame:
    """One row per input row: the stored stream read back, its digests, feature and, with tensors, media and rgb.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, then media binary, width, height and rgb
    binary (height x width x 3). Null and empty texts are one unit of bytes 255.
    Ids may be null or repeat; other columns are ignored; equal texts give equal
    values; an empty table gives none. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if tensors:
        schema += ", media binary, width int, height int, rgb binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                texts = part.column(1).to_pylist()
                media = store([payload_of(t, unit) for t in texts])
                images, coefficients = decode(media)
                samples = samples_of(images, coefficients)
                out = []
                for t, m, image in zip(texts, media, images, strict=True):
                    back = read_back(image, coefficients)
                    rgb = rgb_tensor(image, samples)
                    row = [len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(rgb)]
                    out.append(row + [m, image.width, image.height, rgb.tobytes()] * tensors)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                names = [f.strip().split()[0] for f in schema.split(",")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False))], names=names)

    return rows.mapInArrow(run, schema)


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), tensors=False)
