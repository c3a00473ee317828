"""Document fingerprints by MinHash.

Universal hash permutations over word shingles, vectorised in numpy, give a
signature; a fingerprint keeps one byte of each of its minima, and the share of equal
bytes, less what chance makes equal, estimates the Jaccard similarity. Bands of
signatures are joined in Spark, and what meets there is verified on full shingle sets.
Neighbours in an order meet by one shuffle by ranges; only texts at the edges of
ranges move once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table, text_of
from .minhash_join import near_duplicates, ngrams
from .trie_counts import slices

SHINGLE, PERMUTATIONS, SEED = 5, 128, 12
#: Bands of a signature and minima in each: at a similarity of 0.8 two texts meet with a probability of 0.998.
BANDS, ROWS = 21, 6
#: Word hashes of a worker's memory; when full they are dropped and gathered anew.
KEPT = 300_000
#: Shingles that are permuted together.
STEP = 1024


class Signer:
    """Signatures of texts and of texts with an edited end."""

    def __init__(self, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.n = shingle
        self.a = rng.integers(0, 2**32, permutations, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, permutations, dtype=np.uint32)
        self.none = np.full(permutations, 0xFFFFFFFF, np.uint32)
        self.words: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> list[int]:
        """A hash of each word. Words are bytes free of ASCII white space, A-Z lower-cased."""
        known = self.words
        if len(known) > KEPT:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out

    def shingles(self, hashes: list[int]) -> np.ndarray:
        """32-bit hashes of all runs of n words; none of fewer words."""
        if len(hashes) < self.n:
            return np.empty(0, np.uint32)
        return self._joined(np.array(hashes, np.uint64), self.n)

    @staticmethod
    def _joined(h: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
            out ^= out >> np.uint64(29)
        return ((out * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """The least value under each permutation."""
        low = self.none.copy()
        for k in range(0, len(shingles), STEP):
            np.minimum(low, (shingles[k : k + STEP, None] * self.a + self.b).min(0), out=low)
        return low

    def begun(self, text: str) -> tuple[bytes, list[int], np.ndarray]:
        """Of a text's head, that is all but the last floor(n / 4) code points: what follows its last whole word, its last n words, all if fewer, and its minima."""
        head = text[: len(text) - len(text) // 4].encode().lower()
        words = head.split()
        # The last word may go on in what follows.
        open_end = words.pop() if words and not head[-1:].isspace() else b""
        hashes = self.hashes(words)
        return open_end, hashes[-self.n :], self.minima(self.shingles(hashes))

    def ended(self, head: tuple[bytes, list[int], np.ndarray], rest: str) -> np.ndarray | None:
        """The signature of a head with the rest of the text; None where it has no words."""
        open_end, last, low = head
        hashes = last + self.hashes((open_end + rest.encode().lower()).split())
        if not hashes:
            return None
        if len(hashes) < self.n:  # so few that last has all words of the head
            return self.minima(self._joined(np.array(hashes, np.uint64), len(hashes)))
        # The last n words of the head are a shingle of the head already.
        return np.minimum(low, self.minima(self.shingles(hashes[1:] if len(last) == self.n else hashes)))

    def signature(self, text: str) -> np.ndarray | None:
        return self.ended(self.begun(text), text[len(text) - len(text) // 4 :])

    @staticmethod
    def fingerprint(signature: np.ndarray | None) -> bytes:
        """A byte of each minimum; of a text without words nothing."""
        return b"" if signature is None else ((signature * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard similarity of two fingerprints' texts; texts without words are alike, and like no others."""
    if not a or not b:
        return float(a == b)
    share = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / len(a)
    return max(0.0, (share - 1 / 256) / (1 - 1 / 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (binary) and bands (array, empty for a text without words) of each row's whole text.

    Equal texts, and texts with the same words, have equal fingerprints. Null texts are
    empty. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            for some in slices(batch, 1, 4 << 20):
                texts = some.column(1).to_pylist()
                made = [signer.signature(t) for t in texts]
                columns = [some.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(signer.fingerprint, made), pa.binary()), pa.array(map(band_hashes, made), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint", "bands"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return held.mapInArrow(run, "doc_id long, n_chars long, fingerprint binary, bands array<long>")


def band_hashes(signature: np.ndarray | None) -> list[int]:
    """One hash for each band; which band it is counts."""
    if signature is None:
        return []
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in signature[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64).tolist()


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


class _Rows:
    """Rows of OUT, gathered in columns."""

    def __init__(self, signer: Signer) -> None:
        self.signer = signer
        self.columns: list[list] = [[] for _ in range(7)]

    def add(self, doc_id: int | None, text: str, head: tuple, mark: bytes, following: str, next_mark: bytes) -> None:
        n = len(text) // 4
        end = following[:n]
        edited = self.signer.fingerprint(self.signer.ended(head, end))
        digest = hashlib.sha256((text[: len(text) - n] + end).encode()).hexdigest()
        for column, value in zip(self.columns, (doc_id, len(text), digest, mark, edited, likeness(mark, edited), likeness(mark, next_mark)), strict=True):
            column.append(value)

    def taken(self) -> list[pa.Array]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        out = [pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)]
        self.columns = [[] for _ in range(7)]
        return out


NAMES = [f.split()[0] for f in OUT.split(", ")]


def beside_next(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its text with an edited end, and how like it the edited text and the next row are.

    The last floor(n / 4) code points give way to the first as many, or all, of the next
    row's text. Rows ascend by doc_id (null first), those of one id by their texts'
    hashes; the last row is followed by the first, and so is a row that is alone. Null
    texts are empty; texts are whole, however long; equal texts have equal
    fingerprints; repeated rows follow one another. Other columns are ignored. Empty
    in, empty out.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    order = ["doc_id", "_hash", "_own"]
    held = held.withColumn("_hash", F.xxhash64("text")).withColumn("_own", F.monotonically_increasing_id())
    ranges = held.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, place, last, first = Signer(), TaskContext.get().partitionId(), None, None
        rows = _Rows(signer)
        for batch in batches:
            for some in slices(batch, 1, 4 << 20):
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    head = signer.begun(text)
                    mark = signer.fingerprint(signer.ended(head, text[len(text) - len(text) // 4 :]))
                    if last is None:
                        first = text
                    else:
                        rows.add(*last, text, mark)
                    last = (doc_id, text, head, mark)
                made = rows.taken()
                blank = [pa.nulls(len(made[0]), k) for k in (pa.int32(), pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays(made + blank, names=[*NAMES, "place", "first_text", "last_text"])
        if last is not None:
            edge = [pa.array([last[0]], pa.int64()), *[pa.nulls(1, k) for k in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]]
            edge += [pa.array([place], pa.int32()), pa.array([first]), pa.array([last[1]])]
            yield pa.RecordBatch.from_arrays(edge, names=[*NAMES, "place", "first_text", "last_text"])

    made = materialise(ranges.mapInArrow(run, f"{OUT}, place int, first_text string, last_text string"), "neighbours")
    edges = made.filter("place is not null")
    # A row for each range of rows, without texts.
    over = W.orderBy("place")
    after = edges.select("place").withColumn("_next", F.coalesce(F.lead("place").over(over), F.min("place").over(W.partitionBy())))
    firsts = edges.select(F.col("place").alias("_next"), F.col("first_text").alias("following"))
    pairs = edges.select("place", "doc_id", "last_text").join(after, "place").join(firsts, "_next").select("doc_id", "last_text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            rows = _Rows(signer)
            for doc_id, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.add(doc_id, text, signer.begun(text), signer.fingerprint(signer.signature(text)), following, signer.fingerprint(signer.signature(following)))
            yield pa.RecordBatch.from_arrays(rows.taken(), names=NAMES)

    return made.filter("place is null").select(NAMES).unionByName(pairs.mapInArrow(close, OUT))


def similar(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, copy_of, class_id and n_links of each row: texts whose shingle sets' Jaccard similarity is at least the threshold are linked.

    Bands of the signatures are joined, and texts that meet are verified on their full
    sets. Nulls, empty texts and rows that repeat are as in near_duplicates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, known = Signer(), {}
        for batch in batches:
            for some in slices(batch, 2, 4 << 20):
                sets = [ngrams(t, SHINGLE, known) for t in some.column(2).to_pylist()]
                bands = [band_hashes(signer.minima((g >> np.uint64(32)).astype(np.uint32)) if len(g) else None) for g in sets]
                keys = [hashlib.sha256(g.tobytes()).digest()[:16] for g in sets]
                columns = [*some.columns[:2], pa.array(keys, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "set_key", "grams", "bands"])

    def sign(plain: DataFrame) -> DataFrame:
        held = plain.select("row", "doc_id", text_of("text").cast("binary").alias("text"))
        return held.mapInArrow(run, "row long, doc_id long, set_key binary, grams long, bands array<long>")

    return near_duplicates(docs, n=SHINGLE, threshold=threshold, sign=sign)


def op12_text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = beside_next(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
