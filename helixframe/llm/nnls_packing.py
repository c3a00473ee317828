"""Sequence packing by non-negative least squares over the length histogram.

Documents are cut into windows and one remainder. Combinations of up to three
length bins that fill a window are enumerated, repeat counts are solved against
the histogram and rounded down, and what is left over is packed greedily in one
stream that is cut where a window is full. Planning moves lengths alone; token
ids move once, to their places.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, sum_before, table, text_of
from .trie_counts import slices

TOKENIZER, END_ID, WINDOW = "word_bpe_49k.json", 2, 4096
#: Length bins of a window, and the most pieces that a combination has.
BINS, DEPTH = 256, 3
#: Rows that a part of a ranking holds, or the square root of a bin's rows if that is more; windows of a stream.
RANKED, STREAM_WINDOWS = 1000, 32
#: Words whose ids a worker keeps; when full they are dropped and gathered anew.
KEPT = 900_000
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordIds(dict):
    """Token ids of words free of ASCII white space, as little-endian 16-bit or 32-bit numbers.

    The tokenizer drops white space and never joins what it parts, so a text's ids
    are those of its words in order. Words of Latin letters go straight to the
    tokenizer's model, one pre-token at a time; all others, and those that hold an
    added token such as <|endoftext|>, through the whole tokenizer.
    """

    #: The tokenizer file's own pattern of pre-tokens.
    PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens count as such only as a text spells them, so lower-cased words see none.
        self.lowered = Tokenizer.from_file(path)
        self.lowered.encode_special_tokens = True
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.direct = path.endswith(TOKENIZER)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.code = "H" if self.kind.itemsize == 2 else "I"

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(PUNCTUATION)
        if not self.direct:
            ids = self._whole(word)
        elif word.isalpha():  # ASCII letters alone are one pre-token
            ids = self._part(word.decode())
        elif len(stem) < len(word) and stem[-1:].isalnum():
            # Marks after a letter or digit are a pre-token of their own.
            out = self[word] = self[stem] + self[word[len(stem) :]]
            return out
        else:
            text = word.decode("utf-8", "replace")
            if word.isascii() or (max(text) < "ɐ" and "\x85" not in text and "\xa0" not in text and unicodedata.is_normalized("NFC", text)):
                ids = array(self.code)
                for part in self.PRE_TOKENS.findall(text.lower()):
                    ids += self._part(part if part.isascii() and part.isprintable() else "".join([self.letters[b] for b in part.encode()]))
            else:
                ids = self._whole(word)
        out = self[word] = ids.tobytes()
        return out

    def _part(self, mapped: str) -> array:
        return array(self.code, [t.id for t in self.model.tokenize(mapped)])

    def _whole(self, word: bytes) -> array:
        return array(self.code, self.lowered.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _spelled(self, word: bytes) -> bytes:
        """Ids of a word as the text has it, which may hold added tokens."""
        if not any(t in word for t in self.added):
            return self[word.lower()]
        return array(self.code, self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def of(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return b"".join(map(self._spelled, text.split()))
        return b"".join(map(self.__getitem__, text.lower().split()))


_kept: dict[str, WordIds] = {}


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """row, doc_id, n_tokens, ids of each document, its end id included; ids are 16-bit where the vocabulary allows."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _kept:
            _kept[tokenizer] = WordIds(tokenizer)
        words = _kept[tokenizer]
        end = np.array([end_id], words.kind).tobytes()
        for batch in batches:
            for part in slices(batch, 2):
                if len(words) > KEPT:
                    words.clear()
                ids = [words.of(t) + end for t in part.column(2).to_pylist()]
                n = [len(x) // words.kind.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "n_tokens", "ids"])
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return rows.mapInArrow(run, "row long, doc_id long, n_tokens long, ids binary")


def combinations(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to depth bins, each 1 to bins, that add up to bins."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for b in range(min(left, most), 0, -1):
                if b * (depth - len(head)) < left:
                    break
                grow((*head, b), left - b, b)

    grow((), bins, bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares with x >= 0 by active sets: the steepest column enters, negative ones leave on the way."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gradient = np.where(inside, -np.inf, a.T @ (b - a[:, inside] @ x[inside]))
        j = int(gradient.argmax())
        if gradient[j] <= least:
            break
        inside[j] = True
        while True:
            k = np.flatnonzero(inside)
            s = np.linalg.lstsq(a[:, k], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[k] = s
                break
            low = s <= 0
            step = (x[k][low] / np.maximum(x[k][low] - s[low], 1e-300)).min()
            x[k] = np.maximum(x[k] + step * (s - x[k]), 0)
            gone = k[low & (x[k] <= 1e-12 * max(1.0, x.max()))]
            x[gone] = 0
            inside[gone if len(gone) else k[low]] = False
    return x


def plan_combinations(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats), within the histogram of pieces by bin (index 0 is bin 1)."""
    if not histogram.any():
        return []
    bins = len(histogram)
    all_of = [c for c in combinations(bins, depth) if all(histogram[b - 1] for b in c)]
    if not all_of:
        return []
    a = np.zeros((bins, len(all_of)))
    for j, c in enumerate(all_of):
        for b in c:
            a[b - 1, j] += 1
    # A long piece left over wastes more than a short one.
    weight = np.sqrt(np.arange(1, bins + 1) / bins)
    x = nnls(a * weight[:, None], histogram * weight)
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        need = a[:, j].astype(np.int64)
        n = min(int(x[j] + 1e-6), int((left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left -= n * need
            out.append((all_of[j], n))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian 32-bit).

    Every id of every document, its end id included, lies in one piece. Null and
    empty texts are documents of the end id alone. Ids may be null or repeat: each
    row is a document of its own. Other columns are ignored. An empty table gives
    no pieces. window must be a multiple of bins.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = materialise(tokenise(given, path, end_id), "tokens")

    step = window // bins
    lengths = tokens.select("row", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(window).cast("long"))).alias("start"))
    pieces = lengths.select("row", "start", F.least(F.lit(window), F.col("n_tokens") - F.col("start")).cast("long").alias("length")).withColumn("bin", F.ceil(F.col("length") / step).cast("int"))
    counts = {r["bin"]: r["n"] for r in pieces.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # bins rows at most
    histogram = np.array([counts.get(b, 0) for b in range(1, bins + 1)])
    plan = plan_combinations(histogram, depth)

    # Places in the planned sequences: by bin, runs of ranks that take one place of one combination.
    taken, base, runs = dict.fromkeys(range(1, bins + 1), 0), 0, []
    for combination, n in plan:
        for place, b in enumerate(combination):
            runs.append((b, taken[b], taken[b] + n, base, place))
            taken[b] += n
        base += n
    places = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "bin int, low long, high long, base long, place int")

    # Rank within a bin in two steps, so that a bin with a third of all pieces is many tasks' work.
    parts = [max(1, int(np.ceil(n / max(RANKED, np.sqrt(n))))) for n in histogram]
    own_parts = F.element_at(F.array(*[F.lit(p).cast("long") for p in parts]), F.col("bin"))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row", "start"), own_parts))
    before = dealt.groupBy("bin", "part").count().select("bin", "part", (F.sum("count").over(W.partitionBy("bin").orderBy("part")) - F.col("count")).alias("before"))
    own = dealt.withColumn("own", F.row_number().over(W.partitionBy("bin", "part").orderBy("row", "start")) - 1)
    ranked = own.join(before, ["bin", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    # A solution has as many combinations as bins at most, each with depth places: a bounded table.
    placed = ranked.join(F.broadcast(places), (ranked["bin"] == places["bin"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left").drop(places["bin"])
    placed = materialise(placed.select("row", "start", "length", "part", (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "place"), "placed")

    in_order = W.partitionBy("sequence_id").orderBy("place")
    planned = placed.filter("sequence_id is not null").select("row", "start", "length", "sequence_id", (F.sum("length").over(in_order) - F.col("length")).alias("offset"))

    # The rest, in streams of bounded length: each fills window after window and is cut at their ends.
    rest = placed.filter("sequence_id is null").select("row", "start", "length")
    total = rest.agg(F.sum("length")).first()[0] or 0
    streams = max(1, total // (STREAM_WINDOWS * window))
    rest = rest.withColumn("stream", F.pmod(F.xxhash64("row", "start", F.lit(3)), F.lit(streams)))
    firsts = rest.groupBy("stream").agg(F.ceil(F.sum("length") / window).alias("windows"))
    firsts = sum_before(firsts, "stream", "windows", "before").select("stream", (F.lit(base) + F.col("before")).alias("first"))
    laid = rest.withColumn("end", F.sum("length").over(W.partitionBy("stream").orderBy("row", "start"))).withColumn("begin", F.col("end") - F.col("length"))
    cut = laid.join(firsts, "stream").withColumn("w", F.explode(F.sequence(F.floor(F.col("begin") / window), F.floor((F.col("end") - 1) / window))))
    low, high = F.greatest("begin", F.col("w") * window), F.least("end", (F.col("w") + 1) * window)
    streamed = cut.select("row", (F.col("start") + low - F.col("begin")).alias("start"), (high - low).alias("length"), (F.col("first") + F.col("w")).alias("sequence_id"), (low - F.col("w") * window).alias("offset"))

    joined = planned.unionByName(streamed).join(tokens, "row")
    width = F.octet_length("ids") / F.col("n_tokens")
    own_ids = F.substring(F.col("ids"), (F.col("start") * width + 1).cast("int"), (F.col("length") * width).cast("int"))
    return _wide(joined.select("doc_id", "start", "length", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset", own_ids.alias("ids")))


def _wide(pieces: DataFrame) -> DataFrame:
    """Ids as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 6):
                wide = [np.frombuffer(x, "<u2").astype("<u4").tobytes() if len(x) == 2 * n else x for x, n in zip(part.column(6).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(wide, pa.binary())], names=part.schema.names)

    return pieces.mapInArrow(run, pieces.schema)


def digests(pieces: DataFrame) -> DataFrame:
    """The columns of the query from packed pieces."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
