"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree over the bytes before
it. A node's Krichevsky-Trofimov estimate comes from the counts of the whole
training corpus; weights mix the estimates of all depths. The tree has every
context that occurs LEAST times, so it grows with the corpus; the rarer
continuations of a context share one leaf, so that every count is in the model.
What results is one code length for each distinct string of a context and a byte.
Strings are weighed in parts and looked up by parts; none of these tables is
broadcast. A smoothed unigram score over words goes with it.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, table, text_of
from .trie_counts import slices

#: Bytes of context; a context is in the tree if it occurs so often, whatever the size of the corpus.
DEPTH, LEAST = 6, 2
#: Bytes that the contexts of one part end in alike.
SPLIT = 3
#: Ends a text and stands before it; no byte of UTF-8.
END = 0xFF
#: Steps of a bit in which code lengths are kept, rounded up.
STEPS = 512
#: Frequent words that scoring holds in memory, and the longest of them; all others are joined.
HOT_WORDS, HOT_LENGTH = 1 << 16, 64
#: Distinct words or byte strings after which a training task hands on its counts.
FLUSH = 600_000
#: Text that one counting task should see at least, text of a chunk, and text for each part of the distinct strings.
TASK_BYTES, CHUNK_BYTES, PART_BYTES = 40 << 20, 24 << 20, 24 << 20


def framed(texts: list[bytes | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case texts, each after depth end bytes and with one at its end, and where each begins."""
    parts = [END.to_bytes() * depth]
    starts, at = [], depth
    for t in texts:
        starts.append(at)
        parts.append((t or b"").lower())
        parts.append(END.to_bytes() * depth)
        at += len(t or b"") + depth
    return np.frombuffer(b"".join(parts), np.uint8), np.array(starts, np.int64)


def coded(texts: list[bytes | None], starts: np.ndarray) -> np.ndarray:
    """Positions that are coded: every byte of each text and the end after it."""
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.repeat(starts - first, sizes) + np.arange(sizes.sum())


def string_counts(texts: list[bytes | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of depth + 1 bytes, the coded one last, and how often each occurs."""
    data, starts = framed(texts, depth)
    key = np.zeros(len(data) - depth, np.uint64)
    for k in range(depth + 1):
        key = (key << np.uint64(8)) | data[k : len(data) - depth + k]
    return np.unique(key[coded(texts, starts) - depth], return_counts=True)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def corpus_words(train: DataFrame) -> DataFrame:
    """token binary, c long over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(tally.keys()), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    tally.update(t.lower().split())
                if len(tally) > FLUSH:
                    yield flush()
                    tally.clear()
        if tally:
            yield flush()

    return train.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x of at least one half."""
    rising = np.ones_like(x)
    for k in range(8):
        rising *= np.minimum(x, 1e6) + k
    y = np.where(x < 1e6, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return series - np.where(x < 1e6, np.log(rising), 0)


def binary_counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) at the 255 decisions of a byte, from the first bit to the last, for rows of 256 byte counts."""
    zeros, ones = [], []
    for _ in range(8):
        pairs = n.reshape(len(n), n.shape[1] // 2, 2)
        zeros.insert(0, pairs[:, :, 0])
        ones.insert(0, pairs[:, :, 1])
        n = pairs.sum(2)
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


#: log Gamma of n + 1/2 and of n + 1 for the counts that most nodes have.
_TABLE = 1 << 16
_HALVES = math.lgamma(0.5) + np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))])
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE)))])


def _looked_up(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(n, _TABLE - 1)]
    large = np.nonzero(n >= _TABLE)
    if len(large[0]):
        out[large] = _lgamma(n[large].astype(float) + more)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _looked_up(zeros, _HALVES, 0.5) + _looked_up(ones, _HALVES, 0.5) - math.log(math.pi) - _looked_up(zeros + ones, _WHOLES, 1.0)


def code_lengths(one: np.ndarray) -> np.ndarray:
    """Code length of each byte in steps of a bit, rounded up, from the probabilities of a one at the 255 decisions."""
    bits, at = np.zeros((len(one), 1)), 0
    for k in range(8):
        p = one[:, at : at + (1 << k)]
        bits = np.stack([bits - np.log2(1 - p), bits - np.log2(p)], 2).reshape(len(one), 2 << k)
        at += 1 << k
    return np.minimum(np.ceil(bits * STEPS), 65535).astype(np.uint16)


@dataclass(frozen=True)
class Tree:
    """child[node, symbol]: the next node, or ~leaf; lengths[leaf, symbol]: the code length of a byte there.

    symbol[byte] numbers the bytes that training saw; all others share the last number,
    with the longest code length among them.
    """

    symbol: np.ndarray
    child: np.ndarray
    lengths: np.ndarray
    depth: int

    def bits(self, texts: list[bytes | None]) -> np.ndarray:
        """Code length of each text and its end, in bits."""
        if not texts:
            return np.zeros(0)
        data, starts = framed(texts, self.depth)
        at = coded(texts, starts)
        data, width = self.symbol[data], self.child.shape[1]
        flat = self.child.ravel()
        node = flat[data[at - 1]]
        for d in range(2, self.depth + 1):
            inner = node >= 0
            node = np.where(inner, flat[np.where(inner, node, 0) * width + data[at - d]], node)
        length = self.lengths.ravel()[~node * width + data[at]]
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        return np.add.reduceat(length.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])) / STEPS


def _reversed(context: np.ndarray, d: int) -> np.ndarray:
    """Contexts with the nearest byte first, so that those which end alike are neighbours."""
    out = np.zeros_like(context)
    for k in range(d):
        out |= ((context >> 8 * k) & 255) << 8 * (d - 1 - k)
    return out


class _Level:
    """The contexts of one length, in order of their nearest bytes, and their counts."""

    def __init__(self, rows: pd.DataFrame, d: int) -> None:
        rev = _reversed(rows["context"].to_numpy(np.int64), d)
        order = np.argsort(rev, kind="stable")
        self.names, first = np.unique(rev[order], return_index=True)
        self.byte, self.n = rows["byte"].to_numpy(np.int64)[order], rows["n"].to_numpy(np.int64)[order]
        self.first = np.append(first, len(order))

    def counts(self, low: int, high: int) -> np.ndarray:
        """Rows of 256 counts for contexts low to high."""
        a, b = self.first[low], self.first[high]
        out = np.zeros((high - low, 256), np.int64)
        out[np.repeat(np.arange(high - low), np.diff(self.first[low : high + 1])), self.byte[a:b]] = self.n[a:b]
        return out


def _node(n: np.ndarray, below: dict | None, up: np.ndarray | None) -> dict:
    """Weighs contexts with counts n against what is below them; up: the context above each of those.

    Continuations that are not contexts themselves share a leaf with the rest of the counts.
    """
    kt = binary_counts(n)
    estimate = log_kt(*kt)
    inner = np.zeros(len(n), bool)
    out = {"n": n, "kt": kt, "inner": inner, "rest": None, "weighted": estimate, "stop": np.ones(estimate.shape)}
    if below is None or not len(below["n"]):
        return out
    rest, product = n.copy(), np.zeros(estimate.shape)
    np.subtract.at(rest, up, below["n"])
    np.add.at(product, up, below["weighted"])
    inner[up] = True
    product[inner] += log_kt(*binary_counts(rest[inner]))
    both = np.logaddexp(estimate, product) - math.log(2)
    out["weighted"] = np.where(inner[:, None], both, estimate)
    out["stop"] = np.where(inner[:, None], np.exp(np.minimum(estimate - both - math.log(2), 0)), 1.0)
    out["rest"] = rest
    return out


def _one(kt: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (kt[1] + 0.5) / (kt[0] + kt[1] + 1.0)


#: Contexts of the deepest level that are weighed at once.
TOGETHER = 2048


def grow(rows: pd.DataFrame, depth: int) -> Tree:
    """The weighted tree of gathered counts.

    Contexts that end in the same two bytes are weighed together and twice: once for
    the levels above, once, with what those have left over, for the leaves. So a
    few thousand contexts are held in full at a time.
    """
    levels = [_Level(rows[rows["d"] == d], d) for d in range(depth + 1)]
    if not len(levels[0].names):
        return Tree(np.arange(256), np.full((1, 256), ~0), code_lengths(np.full((1, 255), 0.5)), depth)
    seen = np.unique(np.append(levels[0].byte, END))
    unseen = np.setdiff1d(np.arange(256), seen)
    symbol = np.full(256, len(seen))
    symbol[seen] = np.arange(len(seen))
    ups = [None, *(np.searchsorted(levels[d - 1].names, levels[d].names >> 8) for d in range(1, depth + 1))]
    split = min(2, depth)

    # Runs of contexts of two bytes, with the bounds of all that end in them at every level.
    bounds = {d: np.searchsorted(levels[d].names, levels[split].names << 8 * (d - split)) for d in range(split, depth + 1)}
    bounds = {d: np.append(b, len(levels[d].names)) for d, b in bounds.items()}
    weight = sum(np.diff(b) for b in bounds.values())
    runs, low = [], 0
    while low < len(weight):
        high = max(low + 1, int(np.searchsorted(np.cumsum(weight[low:]), TOGETHER, "right")) + low)
        runs.append((low, high))
        low = high

    def climb(low: int, high: int) -> list[tuple[dict, int, int]]:
        """Levels from the two bytes on, for a run."""
        out, below = [], None
        for d in range(depth, split - 1, -1):
            a, b = int(bounds[d][low]), int(bounds[d][high])
            up = ups[d + 1][bounds[d + 1][low] : bounds[d + 1][high]] - a if d < depth else None
            below = _node(levels[d].counts(a, b), below, up)
            out.insert(0, (below, a, b))
        return out

    tops = {"n": np.zeros((len(levels[split].names), 256), np.int64), "weighted": np.zeros((len(levels[split].names), 255))}
    for low, high in runs:
        top = climb(low, high)[0][0]
        tops["n"][low:high], tops["weighted"][low:high] = top["n"], top["weighted"]
    upper, below = [], tops
    for d in range(split - 1, -1, -1):
        below = _node(levels[d].counts(0, len(levels[d].names)), below, ups[d + 1])
        upper.insert(0, (below, 0, len(levels[d].names)))
    del tops

    nodes, leaves = 0, 0
    child: list[np.ndarray] = []
    lengths: list[np.ndarray] = []

    def place(d: int, here: dict, low: int, above: dict) -> dict:
        """Adds the rows of a level. above: what is mixed and left over where its contexts hang, and their nodes."""
        nonlocal nodes, leaves
        m = len(here["n"])
        up = ups[d][low : low + m] - above["low"] if d else np.zeros(m, np.int64)
        mixed = above["mixed"][up] + above["left"][up] * here["stop"] * _one(here["kt"])
        left = above["left"][up] * (1 - here["stop"])
        inner = here["inner"]
        final = mixed.copy()
        if inner.any():
            final[inner] += left[inner] * _one(binary_counts(here["rest"][inner]))
        long = code_lengths(final)
        lengths.append(np.column_stack([long[:, seen], long[:, unseen].max(1, initial=0)]))
        leaf = ~(leaves + np.arange(m))
        branching = inner | (d == 0)  # the root has a row in any case: scoring begins there
        number = np.where(branching, nodes + np.cumsum(branching) - 1, leaf)
        child.append(np.repeat(leaf[branching][:, None], len(seen) + 1, 1).astype(np.int32))
        if d:
            row = above["number"][up]
            above["child"][row - above["base"], symbol[levels[d].names[low : low + m] & 255]] = number
        out = {"mixed": mixed, "left": left, "number": number, "low": low, "base": nodes, "child": child[-1]}
        leaves += m
        nodes += int(branching.sum())
        return out

    state = {"mixed": np.zeros((1, 255)), "left": np.ones((1, 255)), "low": 0}
    for d, (here, low, _) in enumerate(upper):
        state = place(d, here, low, state)
    for low, high in runs:
        above = state
        for d, (here, a, b) in enumerate(climb(low, high), split):
            if a == b:
                break
            above = place(d, here, a, above)
    return Tree(symbol, np.ascontiguousarray(np.concatenate(child)), np.ascontiguousarray(np.concatenate(lengths)), depth)


#: Keys in a row of a written table.
ROW_KEYS = 1 << 20


def pack(values: np.ndarray) -> bytes:
    """Numbers as zstd of their first bytes, second bytes and so on, which are far smaller than the numbers."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.ravel().view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack(np.diff(keys, prepend=np.int64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.int64))


def part_of(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """Parts of strings: those whose contexts end in the same three bytes have the same one."""
    ends = (keys >> 8) & ((1 << 8 * min(SPLIT, depth)) - 1)
    return (((ends * 0x9E3779B1) & 0xFFFFFFFF) * parts) >> 32


@dataclass(frozen=True)
class _Nodes:
    """One decision of a byte at all contexts of a level: each string's node, each node's first string, its weight, what stops there and estimates."""

    of: np.ndarray
    first: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    stop: np.ndarray
    one: np.ndarray
    rest_one: np.ndarray


class Part:
    """The contexts of three bytes and more of one part of the corpus's distinct strings, and their weights.

    A level's strings are contexts of its length with a byte behind them, in order of
    the nearest bytes. Only decisions on the way to a byte that some string has are
    held: of most contexts eight for each of a few bytes, not all 255. Strings that
    training does not have go along with counts of zero.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, least: int) -> None:
        self.depth, self.split = depth, min(SPLIT, depth)
        raw = keys.view(np.uint64)
        self.byte = (raw & np.uint64(255)).astype(np.int64)
        context = np.zeros_like(raw)
        for k in range(depth):
            context |= ((raw >> np.uint64(8 * (k + 1))) & np.uint64(255)) << np.uint64(8 * (depth - 1 - k))
        self.parent = (context >> np.uint64(8 * (depth - self.split + 1))).astype(np.int64)
        self.u, self.count, self.above, self.place, self.held = {}, {}, {}, {}, {}
        u, place = np.unique((context << np.uint64(8)) | (raw & np.uint64(255)), return_inverse=True)
        count = np.zeros(len(u), np.int64)
        np.add.at(count, place, n)
        starts = {}
        for d in range(depth, self.split - 1, -1):
            self.u[d], self.count[d], self.place[d] = u, count, place.astype(np.int32)
            starts[d] = self._starts(u >> np.uint64(8))
            rows = np.diff(np.append(starts[d], len(u)))
            self.held[d] = np.repeat(np.add.reduceat(count, starts[d]) >= least, rows) if len(u) else np.zeros(0, bool)
            if d > self.split:
                u, above = np.unique(((u >> np.uint64(16)) << np.uint64(8)) | (u & np.uint64(255)), return_inverse=True)
                self.above[d] = above.astype(np.int32)
                count = np.bincount(above, count, len(u)).astype(np.int64)
                place = above[place]
        # Whether a string's context has longer ones in the tree.
        self.inner = {}
        for d in range(self.split, depth):
            has = np.zeros(len(self.u[d]), bool)
            has[self.above[d + 1][self.held[d + 1]]] = True
            rows = np.diff(np.append(starts[d], len(has)))
            self.inner[d] = np.repeat(np.logical_or.reduceat(has, starts[d]), rows) if len(has) else has

    @staticmethod
    def _starts(values: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)

    def weigh(self, k: int) -> dict[int, _Nodes]:
        """The nodes of the k-th decision on each level."""
        out: dict[int, _Nodes] = {}
        for d in range(self.depth, self.split - 1, -1):
            u, count = self.u[d], self.count[d]
            first = self._starts(u >> np.uint64(8 - k))
            of = np.zeros(len(u), np.int32)
            of[first[1:]] = 1
            of = np.cumsum(of, dtype=np.int32)
            bit = ((u >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            ones = np.add.reduceat(np.where(bit, count, 0), first) if len(u) else np.zeros(0, np.int64)
            zeros = (np.add.reduceat(count, first) if len(u) else ones) - ones
            estimate = log_kt(zeros, ones)
            one = (ones + 0.5) / (zeros + ones + 1.0)
            if d == self.depth:
                out[d] = _Nodes(of, first, zeros, ones, estimate, np.ones(len(first)), one, one)
                continue
            below = out[d + 1]
            there = self.held[d + 1][below.first]
            up = of[self.above[d + 1][below.first[there]]]
            rest_zeros = zeros - np.bincount(up, below.zeros[there], len(first)).astype(np.int64)
            rest_ones = ones - np.bincount(up, below.ones[there], len(first)).astype(np.int64)
            product = np.bincount(up, below.weighted[there], len(first)) + log_kt(rest_zeros, rest_ones)
            inner = self.inner[d][first]
            both = np.logaddexp(estimate, product) - math.log(2)
            stop = np.where(inner, np.exp(np.minimum(estimate - both - math.log(2), 0)), 1.0)
            out[d] = _Nodes(of, first, zeros, ones, np.where(inner, both, estimate), stop, one, (rest_ones + 0.5) / (rest_zeros + rest_ones + 1.0))
        return out

    def tops(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By the context above the shortest ones here: counts, counts of the contexts here, and the product of their weights."""
        s = self.split
        u, held = self.u[s], self.held[s]
        parents, up = np.unique((u >> np.uint64(16)).astype(np.int64), return_inverse=True)
        at = up * 256 + (u & np.uint64(255)).astype(np.int64)
        everything = np.bincount(at, self.count[s], len(parents) * 256).astype(np.int64).reshape(-1, 256)
        inside = np.bincount(at[held], self.count[s][held], len(parents) * 256).astype(np.int64).reshape(-1, 256)
        product = np.zeros((len(parents), 255))
        for k in range(8):
            nodes = self.weigh(k)[s]
            first = nodes.first[held[nodes.first]]
            np.add.at(product, (up[first], self._node(u[first], k)), nodes.weighted[nodes.of[first]])
        yield from zip(parents.tolist(), everything, inside, product, strict=True)

    @staticmethod
    def _node(u: np.ndarray, k: int) -> np.ndarray:
        """Which of the 255 decisions a string's k-th one is."""
        return (1 << k) - 1 + ((u & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)

    def lengths(self, upper: Upper) -> np.ndarray:
        """Code length of each string."""
        if not len(self.byte):
            return np.zeros(0, np.uint16)
        parents = np.searchsorted(upper.names, self.parent)
        out = upper.lengths[upper.row[parents], self.byte]
        # A context in the tree has its shorter ones there.
        here = np.flatnonzero(self.held[self.split][self.place[self.split]])
        parent, byte = parents[here], self.byte[here]
        place = {d: p[here] for d, p in self.place.items()}
        bits = np.zeros(len(here))
        for k in range(8):
            nodes = self.weigh(k)
            node = (1 << k) - 1 + (byte >> (8 - k))
            mixed, left = upper.mixed[parent, node], upper.left[parent, node]
            alive = np.arange(len(here))
            for d in range(self.split, self.depth + 1):
                at = nodes[d].of[place[d][alive]]
                stop, weight = nodes[d].stop[at], left[alive]
                mixed[alive] += weight * stop * nodes[d].one[at]
                left[alive] = weight * (1 - stop)
                on = self.held[d + 1][place[d + 1][alive]] if d < self.depth else np.zeros(len(alive), bool)
                ends = alive[~on]
                mixed[ends] += left[ends] * nodes[d].rest_one[at[~on]]
                alive = alive[on]
            bits -= np.log2(np.where((byte >> (7 - k)) & 1, mixed, 1 - mixed))
        out[here] = np.minimum(np.ceil(bits * STEPS), 65535).astype(np.uint16)
        return out


@dataclass(frozen=True)
class Upper:
    """The contexts shorter than those of the parts.

    names: the longest of them, in order; row: of each one's longest context in the tree,
    among lengths (of all levels, the root first); whole: whether that is itself; mixed
    and left: what the levels up to it mix and leave over.
    """

    names: np.ndarray
    row: np.ndarray
    whole: np.ndarray
    mixed: np.ndarray
    left: np.ndarray
    lengths: np.ndarray


def upper_levels(names: np.ndarray, n: np.ndarray, inside: np.ndarray, product: np.ndarray, depth: int, least: int) -> Upper:
    """names: contexts of all bytes but one of the parts' shortest, in order; n, counts within longer contexts and products of their weights: a row for each.

    Two bytes at most, so 65,536 rows; their upper levels are sums of them.
    """
    levels = []
    for d in range(min(SPLIT, depth) - 1, -1, -1):
        estimate = log_kt(*binary_counts(n))
        inner = inside.any(1)
        rest = n - inside
        both = np.logaddexp(estimate, product + log_kt(*binary_counts(rest))) - math.log(2)
        weighted = np.where(inner[:, None], both, estimate)
        stop = np.where(inner[:, None], np.exp(np.minimum(estimate - both - math.log(2), 0)), 1.0)
        known = n.sum(1) >= least if d else np.ones(len(n), bool)
        shorter, up = np.unique(names >> 8, return_inverse=True) if d else (names, np.zeros(len(n), np.int64))
        levels.append((names, n, rest, stop, known, up))
        names, inside, total, product = shorter, np.zeros((len(shorter), 256), np.int64), np.zeros((len(shorter), 256), np.int64), np.zeros((len(shorter), 255))
        np.add.at(total, up, n)
        np.add.at(inside, up[known], n[known])
        np.add.at(product, up[known], weighted[known])
        n = total
    mixed, left, lengths, rows, row = np.zeros((1, 255)), np.ones((1, 255)), [], 0, np.zeros(1, np.int64)
    for d, (names, n, rest, stop, known, up) in enumerate(reversed(levels)):
        above = up if d else np.zeros(len(n), np.int64)
        mixed, left = mixed[above] + left[above] * stop * _one(binary_counts(n)), left[above] * (1 - stop)
        lengths.append(code_lengths(mixed + left * _one(binary_counts(rest))))
        row = np.where(known, rows + np.arange(len(n)), row[above])
        rows += len(n)
    return Upper(names, row, known, mixed, left, np.concatenate(lengths))


def _by(column: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(value, rows) for each run of rows with one value in a column."""
    rows = (r for batch in batches for k in range(0, batch.num_rows, 64) for r in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True))
    return itertools.groupby(rows, key=lambda r: r[column])


def _cells(part: int, keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    for k in range(0, len(keys), ROW_KEYS):
        yield part, pack_keys(keys[k : k + ROW_KEYS]), pack(values[k : k + ROW_KEYS])


def _batch(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for r in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(r, schema, strict=True)], schema=schema)


_PART = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("held", pa.binary())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("held", pa.binary())])


def chunk_strings(texts: DataFrame, depth: int, parts: int) -> DataFrame:
    """chunk, part, keys, held: the distinct strings of each chunk of texts and how often they occur in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, chunk = [], [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            k, n = _summed(keys, counts)
            p = part_of(k, depth, parts)
            order = np.argsort(p, kind="stable")
            bounds = np.searchsorted(p[order], np.arange(parts + 1))
            for q in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[q] : bounds[q + 1]]
                yield from _batch([(chunk, int(q), pack_keys(k[own]), pack(n[own].astype(np.int32)))], _CHUNK)

        for batch in batches:
            edges = np.flatnonzero(np.diff(batch.column(0).to_numpy(), prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                here = batch.slice(a, b - a)
                if held and (here.column(0)[0].as_py() != chunk or held > 4 * FLUSH):
                    yield from flush()
                    keys, counts, held = [], [], 0
                chunk = here.column(0)[0].as_py()
                for part in slices(here, 2, 2 << 20):
                    text, train = part.column(2).to_pylist(), part.column(1).to_pylist()
                    for wanted in (True, False):
                        some = [t for t, x in zip(text, train, strict=True) if x == wanted]
                        if some:
                            k, n = string_counts(some, depth)
                            keys.append(k.astype(np.int64))
                            counts.append(n if wanted else np.zeros(len(n), np.int64))
                            held += len(k)
                    if held > 6 * FLUSH:
                        k, n = _summed(keys, counts)
                        keys, counts, held = [k], [n], len(k)
        if held:
            yield from flush()
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return texts.select("chunk", "train", "text").mapInArrow(run, "chunk long, part int, keys binary, held binary")


def string_lengths(pieces: DataFrame, depth: int, parts: int, least: int) -> DataFrame:
    """part, keys, held: code length of every distinct string of the corpus. The tree is weighed part by part, its top on the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by(0, batches):
            keys, counts, held = [], [], 0
            for _, k, n in rows:
                keys.append(unpack_keys(k))
                counts.append(unpack(n, np.int32).astype(np.int64))
                held += len(keys[-1])
                if held > 8 * FLUSH:
                    k, n = _summed(keys, counts)
                    keys, counts, held = [k], [n], 0
            yield from _batch(_cells(part, *_summed(keys, counts)), _PART)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part")

    def whole(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[int, np.ndarray, Part]]:
        for part, rows in _by(0, batches):
            rows = list(rows)
            keys, n = np.concatenate([unpack_keys(r[1]) for r in rows]), np.concatenate([unpack(r[2], np.int64) for r in rows])
            order = np.argsort(keys)
            yield part, keys[order], Part(keys[order], n[order], depth, least)

    strings = materialise(dealt(pieces.select("part", "keys", "held")).mapInArrow(merge, "part int, keys binary, held binary"), "strings")

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("up", pa.int32()), ("n", pa.binary()), ("inside", pa.binary()), ("product", pa.binary())])
        for _, _, p in whole(batches, least):
            yield from _batch(((up, *(x.tobytes() for x in rest)) for up, *rest in p.tops()), schema)

    # Written, so that the parts are weighed together; the driver then takes them one by one: a row for each context of two bytes at most.
    found: dict[int, list[np.ndarray]] = {}
    kinds = (np.int64, np.int64, np.float64)
    tops = materialise(dealt(strings).mapInArrow(top, "up int, n binary, inside binary, product binary"), "tops")
    for r in tops.toLocalIterator():
        given = [np.frombuffer(r[c], k) for c, k in zip(("n", "inside", "product"), kinds, strict=True)]
        found[r["up"]] = [a + b for a, b in zip(found[r["up"]], given, strict=True)] if r["up"] in found else given
    names = np.array(sorted(found) or [0], np.int64)
    empty = [np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(255)]
    n, inside, product = (np.stack(x) for x in zip(*(found.get(int(k), empty) for k in names), strict=True))
    shared = strings.sparkSession.sparkContext.broadcast(upper_levels(names, n, inside, product, depth, least))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, p in whole(batches, least):
            yield from _batch(_cells(part, keys, p.lengths(shared.value)), _PART)

    lengths = materialise(dealt(strings).mapInArrow(place, "part int, keys binary, held binary"), "lengths")
    forget(strings, tops)
    return lengths


def chunk_lengths(pieces: DataFrame, lengths: DataFrame, parts: int) -> DataFrame:
    """chunk, keys, held: the strings of each chunk and their code lengths."""
    both = lengths.select(F.lit(-1).cast("long").alias("chunk"), "part", "keys", "held").unionByName(pieces.select("chunk", "part", "keys", F.lit(None).cast("binary").alias("held")))
    schema = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("held", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by(1, batches):
            known, long = [], []
            for chunk, _, keys, held in rows:
                if chunk < 0:
                    known.append(unpack_keys(keys))
                    long.append(unpack(held, np.uint16))
                    continue
                if known:
                    k = np.concatenate(known)
                    order = np.argsort(k)
                    table, known = (k[order], np.concatenate(long)[order]), []
                yield from _batch([(chunk, keys, pack(table[1][np.searchsorted(table[0], unpack_keys(keys))]))], schema)

    return both.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(run, "chunk long, keys binary, held binary")


def bits_of(texts: list[bytes | None], depth: int, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Code length of each text and its end, in bits, from sorted strings and their lengths."""
    data, starts = framed(texts, depth)
    key = np.zeros(len(data) - depth, np.int64)
    for k in range(depth + 1):
        key = (key << 8) | data[k : len(data) - depth + k]
    u, inverse = np.unique(key[coded(texts, starts) - depth], return_inverse=True)
    long = lengths[np.searchsorted(keys, u)].astype(np.int64)[inverse]
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    return np.add.reduceat(long, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / STEPS


def held_out(doc_id, folds: int = 7, fold: int = 2):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have the end alone. A null id counts as the empty string
    in the fold. Repeated rows count and score as often. Other columns are ignored.
    Without training texts the tree is its root, with no counts. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    train = rows.filter(~held_out(F.col("doc_id")))

    # Counting tasks of some megabytes each: the more text a task sees, the fewer of its counts are sent twice.
    texts, size = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    train = train.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    words = materialise(corpus_words(train), "words")
    known = words.agg(F.count(F.lit(1)), F.sum("c")).first()
    total = (known[1] or 0) + texts
    scale = math.log10(total + known[0] + (texts > 0) + 1)
    end_log = math.log10(texts + 1)
    short = words.filter(F.octet_length("token") <= HOT_LENGTH)
    hot = {bytes(r["token"]): math.log10(r["c"] + 1) for r in short.orderBy(F.desc("c"), "token").limit(HOT_WORDS).toLocalIterator()}

    # The code length of a byte follows from it and its context: distinct strings are scored, chunk by chunk of the texts.
    count, volume = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long") + 1), F.lit(1))).first()
    shift = max(0, int(math.log2(max(1.0, CHUNK_BYTES * count / max(1, volume)))))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    numbered = materialise(numbered.withColumn("chunk", F.shiftright("row", shift)), "texts")
    parts = max(spark.sparkContext.defaultParallelism, -(-volume // PART_BYTES))
    pieces = materialise(chunk_strings(numbered.withColumn("train", ~held_out(F.col("doc_id"))), depth, parts), "pieces")
    lengths = string_lengths(pieces, depth, parts, least)
    found = chunk_lengths(pieces, lengths, parts)
    shared = spark.sparkContext.broadcast(hot)  # bounded: so many words of a bounded length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        cold_type = pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())]))
        at, keys, long, ready = None, [], [], None
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch.column(0).to_numpy(), prepend=-1, append=-1)).tolist()
            texts_only: list[pa.RecordBatch] = []
            for a, b in itertools.pairwise(edges):
                here = batch.slice(a, b - a)
                if here.column(0)[0].as_py() != at:
                    at, keys, long, ready = here.column(0)[0].as_py(), [], [], None
                strings = here.column(1).null_count  # they come before the texts
                for k in range(strings):
                    keys.append(unpack_keys(here.column(4)[k].as_py()))
                    long.append(unpack(here.column(5)[k].as_py(), np.uint16))
                if strings == here.num_rows:
                    continue
                if ready is None:
                    k = np.concatenate(keys)
                    order = np.argsort(k)
                    ready = k[order], np.concatenate(long)[order]
                    keys, long = [], []
                texts_only += [(p, ready) for p in slices(here.slice(strings).select([1, 2, 3]), 2, 1 << 20)]
            for part, known in texts_only:
                texts = part.column(2).to_pylist()
                n_tokens, n_known, logs, cold = [], [], [], []
                for t in texts:
                    tally = Counter(t.lower().split())
                    found, log, rest = 0, 0.0, []
                    for w, k in tally.items():
                        v = hot.get(w)
                        if v is None:
                            rest.append({"token": w, "times": k})
                        else:
                            found += k
                            log += k * v
                    n_tokens.append(tally.total() + 1)
                    n_known.append(found)
                    logs.append(log)
                    cold.append(rest)
                bits = bits_of(texts, depth, *known)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()), pa.array(-bits * math.log10(2), pa.float64()), pa.array(cold, cold_type)],
                    names=["row", "doc_id", "n_tokens", "found", "log", "score", "cold"],
                )

    none = [F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("doc_id", "long"), ("text", "binary"))]
    joined = found.select("chunk", *none, "keys", "held").unionByName(numbered.select("chunk", "row", "doc_id", "text", *[F.lit(None).cast("binary").alias(c) for c in ("keys", "held")]))
    chunks = max(spark.sparkContext.defaultParallelism, -(-volume // CHUNK_BYTES))
    # Chunks meet by chance in a task; the more places there are, the fewer do.
    dealt = joined.repartition(3 * chunks, "chunk").sortWithinPartitions("chunk", F.col("row").asc_nulls_first())
    scored = materialise(dealt.mapInArrow(run, "row long, doc_id long, n_tokens long, found long, log double, score double, cold array<struct<token:binary,times:long>>"), "scored")
    forget(numbered, pieces, lengths)  # all that follows reads what was scored
    rare = scored.select("row", F.explode("cold").alias("w")).select("row", "w.token", "w.times").join(words, "token")
    rare = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"))
    end_known = int(texts > 0)
    return scored.drop("cold").join(rare, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("found") + F.coalesce("more", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )


def op2_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
