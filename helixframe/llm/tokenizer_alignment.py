"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Two tokens of one text are linked where their bytes overlap. Documents are numbered
within chunks; for each pair of ids a chunk has compressed bitmaps of documents, one
for each binary digit of how often a document holds the pair. The planes' union,
popcounted, is the pair's document count there, and the planes' own popcounts give
its links; sums over chunks are the corpus's. Postings return scores: a chunk's
bitmaps, weighted with the counts of their pairs, add up to its documents' columns.
Bitmaps move once, whole by chunk; between the two passes only counts move.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .trie_counts import slices

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents of a chunk, which a bitmap has a bit for, and links after which a chunk ends at the next document.
CHUNK_DOCS, CHUNK_LINKS = 4096, 4_000_000
#: Bytes of bitmaps in one row; a chunk has as many as it takes.
BLOCK_BYTES = 1 << 20
#: Bits of a pair's number that the second tokenizer's id takes.
SHIFT = 15
#: Words of a generation of a worker's memory; the last two are at hand.
KEPT = 200_000
#: A space with other white space beside it, or at an end: there words aren't tokenised each on its own.
TIED = re.compile(r"\s | \s| \Z")

#: Words of Latin letters, ASCII digits and marks, which every version of Unicode parts alike; and the byte-level pre-tokens' pattern, a fixed value.
LATIN = re.compile(r"[\x20-\x7e\n\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ends of lines, which words are parted before as well.
LINES = re.compile(r"(\n+)")

CHUNKS = "chunk long, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part int, pairs array<int>, docs array<int>, links array<int>, owners binary, planes binary, cards binary, bits binary"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(FIRST), public_tokenizers.path(SECOND)


class Aligner:
    """Both tokenizers' ids of a text, groups that end together, and links.

    The first is byte-level and gets the text with a space before it, which the second
    adds itself. Neither joins over a single space between words or over ends of lines,
    so that a word's alignment is the same in all texts and is kept; texts with other
    spacing are tokenised whole.
    """

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        tokens = {i: t for t, i in self.first.get_vocab().items()}
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (tokens.get(i, "") for i in range(max(tokens) + 1))]
        self.bytes_b = [self._piece(i) for i in range(self.second.get_piece_size())]
        if len(self.bytes_b) > 1 << SHIFT or len(self.bytes_a) > 1 << (31 - SHIFT):
            raise ValueError("the vocabularies are too large for pairs of 31 bits")
        self.sizes = tuple(np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.numbers = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.ranked = self._ranked(first)
        self.followed = [f"{i}{end}".encode() for i in self.numbers for end in ",|;\n"]
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace("▁", " ").encode()

    def _aligned(self, data: bytes, a: list[int], b: list[int]) -> tuple | None:
        """n_a, n_b, n_groups, the groups' text and the links' pairs; None where the tokens' bytes aren't the text's."""
        if b"".join([self.bytes_a[i] for i in a]) != data or b"".join([self.bytes_b[i] for i in b]) != data:
            return None
        size_a, size_b, number = [len(self.bytes_a[i]) for i in a], [len(self.bytes_b[i]) for i in b], self.numbers
        next_a, next_b = zip(a, size_a, strict=True), zip(b, size_b, strict=True)
        (one, ahead), (two, behind) = next(next_a), next(next_b)
        ahead -= behind
        links, groups, from_a, from_b = [one << SHIFT | two], [], number[one], number[two]
        for _ in range(len(a) + len(b)):
            if ahead < 0:
                one, size = next(next_a)
                ahead += size
                from_a += "," + number[one]
            elif ahead > 0:
                two, size = next(next_b)
                ahead -= size
                from_b += "," + number[two]
            else:
                groups.append(from_a + "|" + from_b)
                one, ahead = next(next_a, (None, 0))
                if one is None:
                    break
                two, size = next(next_b)
                ahead -= size
                from_a, from_b = number[one], number[two]
            links.append(one << SHIFT | two)
        return len(a), len(b), len(groups), ";".join(groups).encode(), pack(f"<{len(links)}i", *links)

    def _learn(self, words: set[str]) -> None:
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        unknown = []
        for w in words - self.new.keys():
            if w in self.old:
                self.new[w] = self.old[w]
            else:
                unknown.append(w)
        for start in range(0, len(unknown), 4096):
            some = unknown[start : start + 4096]
            spelled = [w if w[0] == "\n" else " " + w for w in some]
            a = self._first_ids(spelled)
            # The second has put a space before a line's end, too: a piece of its own, since none has one before a line's end.
            b = [ids[1:] if w[0] == "\n" else ids for w, ids in zip(some, self.second.encode(some, num_threads=1), strict=True)]
            self.new.update(zip(some, self._together([s.encode() for s in spelled], a, b), strict=True))

    def _first_ids(self, spelled: list[str]) -> list[list[int]]:
        """Ids of the first tokenizer. Where its merges are in the order of their ids, Latin words go through a quicker program that applies just these."""
        if self.ranked is None:
            return [e.ids for e in self.first.encode_batch_fast(spelled, add_special_tokens=False)]
        out = [self.ranked.encode_ordinary(s) if LATIN.fullmatch(s) else None for s in spelled]
        others = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(others, self.first.encode_batch_fast([spelled[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _ranked(self, path: str) -> object | None:
        """The first tokenizer's merges as ranks, or None where their order is another."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, vocabulary = held["model"], held["model"]["vocab"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [vocabulary.get(m) for m in merges] != list(range(256, 256 + len(merges))) or held.get("normalizer") or held["pre_tokenizer"].get("type") != "ByteLevel":
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None

    def _together(self, data: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[tuple | None]:
        """_aligned for many words at once."""
        n_a, n_b, size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b, data))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
        end_a, end_b, end = np.cumsum(self.sizes[0][flat_a]), np.cumsum(self.sizes[1][flat_b]), np.cumsum(size)
        spelled = n_a.all() and n_b.all() and (end_a[np.cumsum(n_a) - 1] == end).all() and (end_b[np.cumsum(n_b) - 1] == end).all()
        whole = b"".join(data)
        if not spelled or any(b"".join(map(of.__getitem__, flat.tolist())) != whole for of, flat in ((self.bytes_a, flat_a), (self.bytes_b, flat_b))):
            return [self._aligned(*x) for x in zip(data, a, b, strict=True)]
        # One link for each stretch between neighbouring ends of either.
        last_a, last_b = end_b[np.searchsorted(end_b, end_a)] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
        ends = np.sort(np.concatenate([end_a, end_b[~last_b]]), kind="stable")
        links = (flat_a[np.searchsorted(end_a, ends)] << SHIFT | flat_b[np.searchsorted(end_b, ends)]).astype("<i4").tobytes()
        upto = (4 * np.searchsorted(ends, end, "right")).tolist()
        groups = np.searchsorted(end_a[last_a], end, "right")
        # Ids in order of group and side, each with what follows it: a comma, a bar, a semicolon, or a line's end behind a word.
        upto_a, upto_b = (np.r_[0, np.flatnonzero(last) + 1] for last in (last_a, last_b))
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        follows = np.where(last_b, 2, 0)
        follows[np.cumsum(n_b) - 1] = 3
        codes = np.empty(len(flat_a) + len(flat_b), np.int64)
        codes[np.arange(len(flat_a)) + upto_b[of_a]] = flat_a * 4 + last_a
        codes[np.arange(len(flat_b)) + upto_a[of_b + 1]] = flat_b * 4 + follows
        text = b"".join(map(self.followed.__getitem__, codes.tolist())).split(b"\n")[:-1]
        pairs = [links[x:y] for x, y in zip([0, *upto], upto, strict=False)]
        return list(zip(n_a.tolist(), n_b.tolist(), np.diff(groups, prepend=0).tolist(), text, pairs, strict=True))

    def whole(self, text: str) -> tuple | None:
        return self._aligned((" " + text).encode(), self.first.encode(" " + text, add_special_tokens=False).ids, self.second.encode(text))

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, the digest of the groups and the links' pairs of each text; zeros and nothing for one without tokens."""
        split = [LINES.sub(r" \1", t).split(" ") if t and not TIED.search(" " + t) else None for t in texts]
        self._learn(set().union(*[w for w in split if w]))
        known = self.new
        for text, words in zip(texts, split, strict=True):
            if words:
                held = [known[w] for w in words]
                if None in held:
                    held = None
            else:
                one = self.whole(text) if text else None
                held = [one] if one else None
            if held is None:
                yield 0, 0, 0, "", np.empty(0, np.int32)
                continue
            n_a, n_b, n_groups, groups, links = zip(*held, strict=True)
            yield sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(b";".join(groups)).hexdigest(), np.frombuffer(b"".join(links), "<i4")


def planes(pairs: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, plane and slot of each bit that links (a pair, a document's slot) set, in this order."""
    key = np.sort(pairs.astype(np.int64) * CHUNK_DOCS + slots)
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    key, times = key[heads], np.diff(np.r_[heads, len(key)])
    held = []
    for plane in range(int(times.max(initial=0)).bit_length()):
        at = key[(times >> plane) & 1 == 1]
        held.append(((at // CHUNK_DOCS << 5) + plane) * CHUNK_DOCS + at % CHUNK_DOCS)
    bits = np.sort(np.concatenate(held)) if held else np.empty(0, np.int64)
    return bits // CHUNK_DOCS >> 5, bits // CHUNK_DOCS & 31, bits % CHUNK_DOCS


def squeezed(owner: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cardinality and bytes of each owner's bitmap: its slots in 16 bits each, or all bits where these are fewer bytes."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(owner)].astype(np.int64)
    short, out = slots.astype("<u2"), []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if (e - s) * 16 <= CHUNK_DOCS:
            out.append(short[s:e].tobytes())
        else:
            whole = np.zeros(CHUNK_DOCS, np.uint8)
            whole[slots[s:e]] = 1
            out.append(np.packbits(whole).tobytes())
    return ends - starts, out


def opened(cards: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Owner's place and slot of every bit of bitmaps that squeezed() made."""
    sizes = np.where(cards * 16 <= CHUNK_DOCS, cards * 2, CHUNK_DOCS // 8)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(data, np.uint8)
    dense = np.flatnonzero(cards * 16 > CHUNK_DOCS)
    inside = np.ones(len(raw), bool)
    for k in dense:
        inside[ends[k] - sizes[k] : ends[k]] = False
    sparse = np.flatnonzero(cards * 16 <= CHUNK_DOCS)
    owner, slots = [np.repeat(sparse, cards[sparse])], [raw[inside].view("<u2").astype(np.int64)]
    for k in dense:
        at = np.flatnonzero(np.unpackbits(raw[ends[k] - sizes[k] : ends[k]]))
        owner.append(np.full(len(at), k))
        slots.append(at)
    return np.concatenate(owner), np.concatenate(slots)


class Chunk:
    """Documents gathered so far and their links."""

    def __init__(self, number: int) -> None:
        self.number, self.rows, self.pairs, self.slots, self.links = number, [], [], [], 0

    def add(self, doc_id: int | None, n_a: int, n_b: int, n_groups: int, digest: str, pairs: np.ndarray) -> None:
        self.slots.append(np.full(len(pairs), len(self.rows), np.int32))
        self.pairs.append(pairs)
        self.links += len(pairs)
        self.rows.append((doc_id, n_a, n_b, n_groups, len(pairs), digest))

    def full(self) -> bool:
        return len(self.rows) >= CHUNK_DOCS or self.links >= CHUNK_LINKS

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The documents' rows, and rows of bitmaps with their pairs' document and link counts."""

        def batch(n: int, **columns: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        n = len(self.rows)
        yield batch(n, chunk=[self.number] * n, slot=range(n), **dict(zip(names, zip(*self.rows, strict=True), strict=True)))
        pair, plane, slot = planes(np.concatenate(self.pairs), np.concatenate(self.slots))
        if not len(pair):
            return
        # The union of a pair's planes, popcounted, and its planes' popcounts weighted.
        heads = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        union = np.sort(pair * CHUNK_DOCS + slot)
        present = union[np.r_[True, union[1:] != union[:-1]]] // CHUNK_DOCS
        names_of = pair[heads]
        docs = np.diff(np.r_[np.searchsorted(present, names_of), len(present)])
        links = np.add.reduceat(1 << plane, heads)
        owner = (pair << 5) + plane
        cards, bitmaps = squeezed(owner, slot)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        of_pair = np.searchsorted(names_of, pair[first])
        size = np.cumsum([len(b) for b in bitmaps])
        # A pair's planes stay in one part.
        part = (size // BLOCK_BYTES)[np.searchsorted(of_pair, of_pair)]
        for k, number in enumerate(np.unique(part)):
            held = np.flatnonzero(part == number)
            lo, hi = of_pair[held[0]], of_pair[held[-1]] + 1
            yield batch(
                1,
                chunk=[self.number],
                part=[k],
                pairs=[names_of[lo:hi]],
                docs=[docs[lo:hi]],
                links=[links[lo:hi]],
                owners=[(of_pair[held] - lo).astype("<i4").tobytes()],
                planes=[plane[first[held]].astype(np.uint8).tobytes()],
                cards=[cards[held].astype("<u2").tobytes()],
                bits=[b"".join(bitmaps[held[0] : held[-1] + 1])],
            )


_kept: dict[tuple[str, str], Aligner] = {}


def chunks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows of documents (slot is set) and of bitmaps (part is set) of all chunks, to be written once."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _kept:
            _kept[paths] = Aligner(*paths)
        aligner = _kept[paths]
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(number)
        for batch in batches:
            for some in slices(batch, 1, 2 << 20):
                for doc_id, found in zip(some.column(0).to_pylist(), aligner.of(some.column(1).to_pylist()), strict=True):
                    chunk.add(doc_id, *found)
                    if chunk.full():
                        yield from chunk.batches(schema)
                        number += 1
                        chunk = Chunk(number)
        if chunk.rows:
            yield from chunk.batches(schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNKS)


def pair_counts(held: DataFrame) -> DataFrame:
    """a, b, docs and links of every linked pair of ids, of written chunks: documents that hold it linked, and links."""
    each = held.filter("part is not null").select(F.explode(F.arrays_zip("pairs", "docs", "links")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("docs"), F.sum("x.links").alias("links"))
    return counts.select("pair", F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b"), "docs", "links")


def _sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of a chunk's documents that have links: its bitmaps, weighted."""
    scores = {part: f.sort_values("place") for part, f in right.groupby("part")}
    best, low, high = (np.zeros(CHUNK_DOCS) for _ in range(3))
    for part, owners, plane, cards, bits in zip(left["_part"], left["_owners"], left["_planes"], left["_cards"], left["_bits"], strict=True):
        given = scores[part]
        owners = np.frombuffer(owners, "<i4")
        docs, top = given["docs"].to_numpy()[owners], given["best"].to_numpy()[owners]
        owner, slots = opened(np.frombuffer(cards, "<u2").astype(np.int64), bits)
        times = (1 << np.frombuffer(plane, np.uint8).astype(np.int64))[owner]
        # Sums of halves, so that floating-point numbers hold them exactly.
        low += np.bincount(slots, (docs & 0xFFFFF)[owner] * times, CHUNK_DOCS)
        high += np.bincount(slots, (docs >> 20)[owner] * times, CHUNK_DOCS)
        best += np.bincount(slots, top[owner] * times, CHUNK_DOCS)
    at = np.flatnonzero((low > 0) | (high > 0))
    whole = (high[at].astype(np.int64) << 20) + low[at].astype(np.int64)
    return pd.DataFrame({"chunk": np.full(len(at), left["_chunk"][0] if len(left) else 0), "slot": at.astype(np.int32), "n_best": best[at].astype(np.int64), "count_sum": whole})


def scores(held: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of written chunks' documents."""
    top = counts.groupBy("a").agg(F.max("docs").alias("most"))
    valued = counts.join(top, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    asked = held.filter("part is not null").select("chunk", "part", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(valued, "pair").select("chunk", "part", "place", "docs", "best")
    bitmaps = held.filter("part is not null").select(*[F.col(c).alias(f"_{c}") for c in ("chunk", "part", "owners", "planes", "cards", "bits")])
    sums = bitmaps.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_sums, "chunk long, slot int, n_best long, count_sum long")
    out = held.filter("slot is not null").join(sums, ["chunk", "slot"], "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per document with its alignment and scores; and the table of pairs (pair, a, b, docs, links).

    A pair's docs is the number of rows that hold it linked, so rows that repeat count
    each. n_best are a row's links whose pair has the most docs of all pairs of its
    first id; count_sum adds up docs over links. Null and empty texts, and those that
    either tokenizer's tokens do not spell byte for byte, have zeros and an empty
    digest. Texts are whole, however long; null ids are rows like any other; other
    columns are ignored. Empty in, empty out.
    """
    held = materialise(chunks(docs, paths or default_paths()), "alignment")
    counts = materialise(pair_counts(held), "pairs")
    return scores(held, counts), counts


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
