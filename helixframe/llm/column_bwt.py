"""Removal of byte strings that occur elsewhere, by column-wise multi-document suffix ordering.

Every 400-byte string picks one anchor inside itself, the place of its least
64-byte hash; equal strings pick alike, so strings can only be equal at the same
distance from anchors that are. Stretches of text around anchors that occur more
than once are gathered by anchor. There one symbol of each stretch is inserted a
round, from the last column to the first: the symbols before the suffixes in
their order are a column of the collection's Burrows-Wheeler transform, from
which the next order and its common prefixes follow in sequential passes. Since
only suffixes of one column can be equal over 400 bytes, only the newest column
is kept. Runs of 51 words that are shorter than that are found in the same order,
to mark the texts that share a passage. The stretches of an anchor that very many
texts have in different surroundings are split by what windows at like distances
have in common, until each group is small.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, table, text_of
from .trie_counts import slices

LENGTH, GRAM, WORDS = 400, 64, 51
#: Distinct stretches that one group should hold; distances that go together where a larger one is split, step by step.
GROUP, WIDTHS = 8192, (64, 8, 1)
#: Rows that are alike in id and text of which one bucket should hold no more.
REPEATED = 64
#: Windows of a text that are handled at once, and bytes of stretches that are ordered at once.
SLICE, CHUNK = 1 << 20, 12 << 20

_MULTIPLIERS = np.random.default_rng(41).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.default_rng(43).integers(0, 2**63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each string of gram bytes; gram is a power of two."""
    h = _BYTES[data]
    step, k = 1, 0
    while step < gram:
        h = h[:-step] * _MULTIPLIERS[k] + h[step:]
        step, k = step * 2, k + 1
    h ^= h >> np.uint64(32)
    h *= _MULTIPLIERS[7]
    return h ^ (h >> np.uint64(29))


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width keys, by running minima of blocks from both ends."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def word_windows(data: np.ndarray, words: int = WORDS, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """First byte and size of each run of so many words that has fewer bytes than length. Words are parted by ASCII white space."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if len(starts) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = starts[: len(starts) - words + 1]
    sizes = ends[words - 1 :] - starts
    return starts[sizes < length], sizes[sizes < length]


def range_least(key: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Least of count keys from low on, for each of many ranges."""
    out = np.zeros(len(low), np.uint64)
    level = np.frexp(count)[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(key[low[own]], key[low[own] + count[own] - (1 << k)])
        key = np.minimum(key[: -(1 << k)], key[1 << k :])
    return out


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal numbers."""
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.concatenate([first[1:], [len(at)]]) - 1


def anchors_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """For texts that together have SLICE bytes at most: the text of each anchor, and as anchors, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    heads = np.cumsum(sizes + 1) - (sizes + 1)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.repeat(heads + sizes, sizes + 1)
    h = gram_hashes(data, gram) if len(data) >= gram else np.zeros(0, np.uint64)
    low, place = np.uint64(22), np.uint64((1 << 22) - 1)
    key = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    # What reaches over the end of a text is left out.
    at = np.flatnonzero(np.arange(len(data)) + length <= ends)
    picked = (sliding_least(key, length - gram + 1)[at] & place).astype(np.int64) if len(at) else at
    ws, size = word_windows(data, words, length)
    own = ws + size <= ends[ws]
    ws, size = ws[own], size[own]
    word_at = (range_least(key, ws, size - gram + 1) & place).astype(np.int64)
    a = np.union1d(picked, word_at)
    begin, end = np.full(len(a), len(data)), np.zeros(len(a), np.int64)
    owner = np.searchsorted(heads, a, "right") - 1
    head = heads[owner]
    wfirst, wlast = head - 1, head - 1
    if len(at):
        first, last = _runs(picked)
        k = np.searchsorted(a, picked[first])
        begin[k], end[k] = at[first], at[last] + length
    if len(word_at):
        first, last = _runs(word_at)
        k = np.searchsorted(a, word_at[first])
        wfirst[k], wlast[k] = ws[first], ws[last]
        begin[k], end[k] = np.minimum(begin[k], ws[first]), np.maximum(end[k], ws[last] + size[last])
    return owner, h[a].view(np.int64), *(x - head for x in (begin, end, a, wfirst, wlast))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM, words: int = WORDS) -> list[tuple[int, int, int, int, int, int]]:
    """(hash, begin, end, place, first, last) for each anchor: the bytes of all windows that pick it, and its first and last run of words, or -1."""
    out = []
    data = np.frombuffer(text, np.uint8)
    starts, sizes = word_windows(data, words, length)
    low = np.uint64(22)
    for base in range(0, max(len(text) - length + 1, int(starts[-1]) + 1 if len(starts) else 0), SLICE):
        part = data[base : base + SLICE + length - 1]
        h = gram_hashes(part, gram)
        key = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
        place = np.uint64((1 << 22) - 1)
        at = (sliding_least(key, length - gram + 1) & place).astype(np.int64) if len(part) >= length else np.zeros(0, np.int64)
        i, j = np.searchsorted(starts, [base, base + SLICE])
        ws, size = starts[i:j] - base, sizes[i:j]
        word_at = (range_least(key, ws, size - gram + 1) & place).astype(np.int64)
        a = np.union1d(at, word_at)
        begin, end = np.full(len(a), len(part)), np.zeros(len(a), np.int64)
        wfirst, wlast = np.full(len(a), -1 - base), np.full(len(a), -1 - base)
        if len(at):
            first, last = _runs(at)
            k = np.searchsorted(a, at[first])
            begin[k], end[k] = first, last + length
        if len(word_at):
            first, last = _runs(word_at)
            k = np.searchsorted(a, word_at[first])
            wfirst[k], wlast[k] = ws[first], ws[last]
            begin[k], end[k] = np.minimum(begin[k], ws[first]), np.maximum(end[k], ws[last] + size[last])
        out += zip(h[a].view(np.int64).tolist(), *((x + base).tolist() for x in (begin, end, a, wfirst, wlast)), strict=True)
    return out


def repeated_windows(
    group: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, rel: np.ndarray, length: int = LENGTH, runs: list[bytes] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch, by distance before its anchor, whether the window there equals one of another stretch of its group; and whether one of its runs does.

    Groups come in order. rel is an anchor's place in its stretch, runs has pairs of
    a distance and a size below length.
    """
    m = len(group)
    right = size - rel
    found = np.zeros((m, int(rel.max()) + 1), bool)
    wanted, shared = np.zeros(found.shape, np.uint16), np.zeros(m, bool)
    if runs is not None:
        pairs = np.frombuffer(b"".join(runs), np.uint16).reshape(-1, 2)
        wanted[np.repeat(np.arange(m), [len(r) // 4 for r in runs]), pairs[:, 0]] = pairs[:, 1]
    any_run = wanted.any(0)
    origin = start + rel
    bits = max(1, int(2 * m).bit_length())
    by_entry = np.argsort(-right, kind="stable")
    entry = -right[by_entry]
    order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int32)
    entered = 0
    for column in range(int(right.max()) - 1, -int(rel.max()) - 1, -1):
        upto = int(np.searchsorted(entry, -column, "left"))
        if upto > entered:
            new = by_entry[entered:upto]
            order = np.concatenate([np.sort(new), order])
            prefix = np.concatenate([np.zeros(len(new), np.int32), prefix])
            entered = upto
        old = np.flatnonzero(rel[order] >= -column)
        if not len(old):
            continue
        docs = order[old]
        symbol = data[origin[docs] + column].astype(np.int64)  # this column of the transform
        key = np.sort((((group[docs] << 8) | symbol) << bits) | old)
        old = key & ((1 << bits) - 1)
        least = np.minimum.reduceat(np.append(prefix, np.int32(0)), old + 1)
        chain = key >> bits
        prefix = np.zeros(len(key), np.int32)
        prefix[1:] = np.where(chain[1:] == chain[:-1], np.minimum(least[:-1] + 1, length), 0)
        order = order[old]
        if column <= 0:
            hit = np.flatnonzero(prefix >= length)
            found[order[hit], -column] = True
            found[order[hit - 1], -column] = True
            if any_run[-column]:
                need = wanted[order, -column]
                near = np.maximum(prefix, np.append(prefix[1:], np.int32(0)))
                shared[order[(need > 0) & (near >= need)]] = True
    return found, shared


def _ranges(windows: np.ndarray, length: int) -> list[int]:
    """Bytes covered by marked windows: [from, to, from, to, ...]."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], windows.astype(np.int8), [0]])))
    out: list[int] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if out and a <= out[-1]:
            out[-1] = b - 1 + length
        else:
            out += [a, b - 1 + length]
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _digest(rel: int, stretch: bytes, runs: bytes) -> bytes:
    return xxhash.xxh3_128_digest(rel.to_bytes(4, "little") + len(runs).to_bytes(4, "little") + runs + stretch)


HELD = "fp long, rel int, stretch binary, runs binary, digest binary, times long"
_HELD = pa.schema([("fp", pa.int64()), ("rel", pa.int32()), ("stretch", pa.binary()), ("runs", pa.binary()), ("digest", pa.binary()), ("times", pa.int64())])


def find_repeats(held: DataFrame, length: int = LENGTH) -> DataFrame:
    """digest, ranges, passage of each distinct stretch that has repeated windows or runs. held: as HELD, in order of fp."""

    def settle(rows: list[tuple]) -> Iterator[tuple[bytes, list[int], bool]]:
        """rows: as HELD, whole groups."""
        of: dict[bytes, list] = {}
        for row in rows:
            known = of.setdefault(row[4], [*row[:5], 0])
            known[5] += row[5]
        distinct = sorted(of.values(), key=lambda x: x[0])
        fps = np.array([x[0] for x in distinct], np.int64)
        first = np.concatenate([[True], fps[1:] != fps[:-1]])
        group = np.cumsum(first) - 1
        alone = (np.bincount(group) == 1)[group]
        # Stretches that occur twice are repeated as a whole; those without another in their group need no order.
        for x in distinct:
            if x[5] > 1:
                yield x[4], [0, len(x[2])] if len(x[2]) >= length else [], len(x[3]) > 0
        left = [x for x, a in zip(distinct, alone, strict=True) if not a]
        if not left:
            return
        size = np.array([len(x[2]) for x in left], np.int64)
        rel = np.array([x[1] for x in left], np.int64)
        start = np.cumsum(size) - size
        found, shared = repeated_windows(group[~alone], np.frombuffer(b"".join(x[2] for x in left), np.uint8), start, size, rel, length, [x[3] for x in left])
        for k, x in enumerate(left):
            if x[5] == 1 and (shared[k] or found[k].any()):
                yield x[4], _ranges(found[k, rel[k] - np.arange(size[k] - length + 1)], length) if size[k] >= length else [], bool(shared[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held_bytes = 0

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            found = list(settle(rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.bool_())], names=["digest", "ranges", "passage"]
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for row in zip(*columns, strict=True):
                if held_bytes > CHUNK and row[0] != rows[-1][0]:
                    yield packed(rows)
                    rows, held_bytes = [], 0
                rows.append(row)
                held_bytes += len(row[2])
        if rows:
            yield packed(rows)

    return held.mapInArrow(run, "digest binary, ranges array<int>, passage boolean")


def _tally(rows: Iterator[tuple]) -> list[list]:
    """Rows as HELD without times; one for each digest, with the times that it came."""
    of: dict[bytes, list] = {}
    for row in rows:
        known = of.setdefault(row[4], [*row, 0])
        known[5] += 1
    return list(of.values())


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def split(held: DataFrame, width: int, length: int = LENGTH) -> DataFrame:
    """parent, offset and, as HELD, the smaller stretches of each one: windows that start at distances of one step, and each run.

    What all windows of a step have in common is their group's name from here on, so
    equal windows stay in one group. Of width one, a stretch is a window, alone in its group.
    """
    schema = pa.schema([("parent", pa.binary()), ("offset", pa.int32()), *_HELD])

    def parts(fp: int, rel: int, stretch: bytes, runs: bytes, digest: bytes, times: int) -> Iterator[tuple]:
        def part(kind: int, low: int, high: int, begin: int, end: int, core: bytes, own: bytes) -> tuple:
            name = fp.to_bytes(8, "little", signed=True) + bytes([kind]) + low.to_bytes(4, "little") + high.to_bytes(4, "little") + core
            return digest, begin, xxhash.xxh3_64_intdigest(name) - (1 << 63), rel - begin, stretch[begin:end], own, _digest(rel - begin, stretch[begin:end], own), times

        furthest, nearest = rel, rel - (len(stretch) - length)
        for low in range(max(nearest, 0) // width * width, furthest + 1, width) if furthest >= nearest else ():
            near, far = max(low, nearest, 0), min(low + width - 1, furthest)
            # What all windows of a whole step cover; nothing where a step is longer than a window.
            core = stretch[rel - low : max(rel - low, rel - (low + width - 1) + length)]
            yield part(0, low, width, rel - far, rel - near + length, core, b"")
        for distance, size in np.frombuffer(runs, np.uint16).reshape(-1, 2).tolist():
            window = stretch[rel - distance : rel - distance + size]
            yield part(1, distance, size, rel - distance, rel - distance + size, window, np.array([distance, size], np.uint16).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2, 1 << 20):
                of: dict[tuple, list] = {}
                for row in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    for x in parts(*row):
                        of[x[0], x[6]] = x
                yield _batch(list(of.values()), schema)

    return held.mapInArrow(run, f"parent binary, offset int, {HELD}")


def large_repeats(held: DataFrame, length: int, buckets: int, most: int) -> DataFrame:
    """As find_repeats, for stretches of anchors that occur very often: groups of more than so many distinct ones are split."""
    def once(df: DataFrame) -> DataFrame:
        return df.groupBy("fp", "rel", "stretch", "runs", "digest").agg(F.sum("times").alias("times")).select("fp", "rel", "stretch", "runs", "digest", "times")

    def ordered(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "fp").sortWithinPartitions("fp")

    now = materialise(once(held), "large")
    found, steps = [], []
    for width in WIDTHS:
        groups = materialise(now.groupBy("fp").count(), "groups").filter(F.col("count") > most).select("fp")
        if groups.isEmpty():
            break
        found.append(find_repeats(ordered(now.join(groups, "fp", "left_anti")), length))
        parts = materialise(split(now.join(groups, "fp", "left_semi"), width, length), "parts")
        steps.append(parts.select("parent", "offset", "digest"))
        now = materialise(once(parts), "large")
    found.append(find_repeats(ordered(now), length))
    out = materialise(found[-1], "repeats")
    for step, own in zip(reversed(steps), reversed(found[:-1]), strict=True):
        shift = F.transform("ranges", lambda x: x + F.col("offset"))
        up = out.join(step, "digest").select(F.col("parent").alias("digest"), shift.alias("ranges"), "passage").distinct()
        out = materialise(up.unionByName(own), "repeats")
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, words: int = WORDS, most: int = GROUP) -> DataFrame:
    """One row per input row: doc_id, text binary (null where nothing goes), spans, n_bytes, n_removed, n_spans, kept_sha256, repeats_passage.

    A byte goes if any string of length bytes that covers it also starts anywhere
    else, in the same text or another, as the texts are given. repeats_passage is
    true where something goes or a run of so many words occurs anywhere else, byte
    for byte. Null counts as empty; texts with neither lose nothing. Rows alike in id
    and text are texts of their own, hence repeats of each other. Other columns are
    ignored; an empty table gives none.
    """
    if gram > min(length, 2 * words - 1):
        raise ValueError("gram is longer than the shortest window")
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # 128 bits, so that two rows do not share a key by chance.
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary")))
    given = given.select("doc_id", F.col("text").cast("binary").alias("text"), row.alias("row"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("fp", "begin", "end", "at", "first", "last")
        kind = pa.list_(pa.struct([(n, pa.int64() if n == "fp" else pa.int32()) for n in names]))
        for batch in batches:
            for part in slices(batch, 1, SLICE - batch.num_rows):
                texts = part.column(1).to_pylist()
                if part.num_rows > 1 or len(texts[0]) < SLICE:
                    owner, *columns = anchors_of(texts, length, gram, words)
                else:
                    found = anchors(texts[0], length, gram, words)
                    owner, columns = np.zeros(len(found), np.int64), [np.array(c, np.int64) for c in zip(*found, strict=True)]
                fields = pa.StructArray.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)], names=["row", "anchors"])

    mark = "struct<fp:long,begin:int,end:int,at:int,first:int,last:int>"
    long_enough = given.filter(F.octet_length("text") >= min(length, 2 * words - 1))
    listed = materialise(long_enough.select("row", "text").mapInArrow(scan, f"row binary, anchors array<{mark}>"), "anchors")
    each = listed.select("row", F.explode("anchors").alias("a")).select("row", "a.*")
    # Written, so that the join with a very frequent anchor's rows can be split.
    common = materialise(each.groupBy("fp").count().filter("count > 1").select("fp", (F.col("count") > most).alias("often")), "common")
    wanted = each.join(common, "fp").groupBy("row").agg(F.collect_set(F.struct("fp", "begin", "end", "at", "first", "last", "often")).alias("anchors"))

    # Texts with such anchors, once, in buckets by row: neither of the two later reads moves them.
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"stretches_{uuid.uuid4().hex}"
    texts, by = long_enough.select("row", "text"), ["row"]
    # Rows that repeat in id and text many times are dealt to several buckets.
    hot = materialise(listed.groupBy("row").count().filter(F.col("count") > REPEATED).select("row", F.ceil(F.col("count") / REPEATED).alias("ways")), "hot-rows")
    if not hot.isEmpty():
        by = ["row", "way"]
        ways = F.coalesce("ways", F.lit(1).cast("long"))
        texts = texts.withColumn("way", F.monotonically_increasing_id()).join(hot, "row", "left").withColumn("way", F.pmod("way", ways)).drop("ways")
        wanted = wanted.join(hot, "row", "left").select("row", "anchors", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("way"))
    sought = texts.join(wanted.hint("merge"), by).repartition(buckets, *by)
    sought.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, *by).saveAsTable(name)
    sought = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog alone; its files are read by path

    def pieces(text: bytes, marks: list[dict]) -> Iterator[tuple]:
        """As HELD without times, and whether the anchor is a frequent one, for each mark."""
        starts, sizes = word_windows(np.frombuffer(text, np.uint8), words, length)
        low, high = np.searchsorted(starts, [m["first"] for m in marks]), np.searchsorted(starts, [m["last"] for m in marks], "right")
        for m, i, j in zip(marks, low.tolist(), high.tolist(), strict=True):
            runs = np.column_stack([m["at"] - starts[i:j], sizes[i:j]]).astype(np.uint16).tobytes() if m["first"] >= 0 else b""
            rel, stretch = m["at"] - m["begin"], text[m["begin"] : m["end"]]
            yield m["fp"], rel, stretch, runs, _digest(rel, stretch, runs), m["often"]

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(row, m["begin"], x[4]) for row, text, marks in zip(*(c.to_pylist() for c in part.columns), strict=True) for m, x in zip(marks, pieces(text, marks), strict=True)]
                yield _batch(rows, pa.schema([("row", pa.binary()), ("first", pa.int32()), ("digest", pa.binary())]))

    def stretches(batches: Iterator[pa.RecordBatch], often: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 32 << 20):
                texts = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                yield _batch(_tally(x[:5] for text, marks in texts for x in pieces(text, [m for m in marks if m["often"] == often])), _HELD)

    source = sought.select("row", "text", "anchors")
    seen = source.mapInArrow(occurrences, "row binary, first int, digest binary")
    held = source.mapInArrow(lambda batches: stretches(batches, False), HELD)
    repeats = find_repeats(held.repartition(buckets, "fp").sortWithinPartitions("fp"), length)
    if not common.filter("often").isEmpty():
        frequent = source.filter(F.exists("anchors", lambda a: a["often"])).mapInArrow(lambda batches: stretches(batches, True), HELD)
        repeats = repeats.unionByName(large_repeats(frequent, length, buckets, most))
    repeats = materialise(repeats, "repeats")
    spans = F.struct("first", "ranges")
    marked = seen.join(repeats, "digest").groupBy("row").agg(F.collect_list(F.when(F.size("ranges") > 0, spans)).alias("marks"), F.bool_or("passage").alias("passage"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts, gone, removed, shas = [], [], [], []
                passage = part.column(3)
                for text, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    runs = merge([(m["first"] + a, m["first"] + b) for m in marks for a, b in zip(m["ranges"][::2], m["ranges"][1::2], strict=True)])
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    texts.append(kept if runs else None)
                    gone.append([{"begin": a, "end": b} for a, b in runs])
                    removed.append(len(text) - len(kept))
                    shas.append(hashlib.sha256(kept).hexdigest())
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                columns = [part.column(0), pa.array(texts, pa.binary()), pa.array(gone, kind), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), passage]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "spans", "n_removed", "kept_sha256", "passage"])

    kinds = "row binary, text binary, spans array<struct<begin:long,end:long>>, n_removed long, kept_sha256 string, passage boolean"
    stripped = sought.select("row", "text").join(marked, "row").mapInArrow(strip, kinds).dropDuplicates(["row"])
    base = given.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    return base.join(stripped, "row", "left").select(
        "doc_id",
        "text",
        "spans",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        F.coalesce((F.col("n_removed") > 0) | F.col("passage"), F.lit(False)).alias("repeats_passage"),
    )


def op10_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats_passage")
