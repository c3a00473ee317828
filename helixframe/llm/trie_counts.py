"""Unigram token counts by dynamic programming over a shared trie.

Distinct pre-tokens of a batch are put in order and walked as the paths of a
trie: the forward scores of a prefix stay on the current path and are computed
once for all pre-tokens that begin with it. What a terminal node holds is kept
for later batches of the same worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

VOCABULARY = "piece_bpe_32k.model"
WORD_START = "▁"
#: Terminal counts that a worker keeps; when full they are dropped and gathered anew.
KEPT = 1_500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Unigram:
    """Piece scores. The vocabulary file holds ranks, so a piece gets the logarithm of a Zipf probability of its rank.

    A character that is no piece costs as many byte tokens as it has UTF-8 bytes,
    each with the score of the last rank.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        total = np.log((1 / np.arange(1, size + 1)).sum())
        pieces = (i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
        self.scores = {model.id_to_piece(i): float(-np.log(i + 1) - total) for i in pieces}
        self.byte = float(-np.log(size) - total)
        #: Lengths of the pieces of three characters and more by their last three, longest first.
        lengths: dict[str, set[int]] = {}
        for piece in self.scores:
            if len(piece) >= 3:
                lengths.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {end: sorted(of, reverse=True) for end, of in lengths.items()}

    def counts(self, words: list[str]) -> Iterator[tuple[int, float]]:
        """Tokens and score of the best segmentation of each word, of words in order.

        Among equal scores the fewer tokens win.
        """
        score, lengths, byte = self.scores.get, self.lengths.get, self.byte
        best, tokens, before = [0.0], [0], ""
        for word in words:
            shared = len(commonprefix((before, word)))
            del best[shared + 1 :], tokens[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                last = word[i - 1]
                # Each way to end here, by the piece that comes last: bytes, one character, two, and those that end alike.
                size = 1 if last < "\x80" else len(last.encode("utf-8", "surrogatepass"))
                top, fewest = best[i - 1] + byte * size, tokens[i - 1] + size
                s = score(last)
                if s is not None:
                    s += best[i - 1]
                    if s > top or (s == top and tokens[i - 1] + 1 < fewest):
                        top, fewest = s, tokens[i - 1] + 1
                if i > 1:
                    s = score(word[i - 2 : i])
                    if s is not None:
                        s += best[i - 2]
                        if s > top or (s == top and tokens[i - 2] + 1 < fewest):
                            top, fewest = s, tokens[i - 2] + 1
                    for n in lengths(word[i - 3 : i], ()) if i > 2 else ():
                        if n <= i:
                            s = score(word[i - n : i])
                            if s is not None:
                                s += best[i - n]
                                if s > top or (s == top and tokens[i - n] + 1 < fewest):
                                    top, fewest = s, tokens[i - n] + 1
                best.append(top)
                tokens.append(fewest)
            before = word
            yield tokens[-1], best[-1]


_kept: dict[str, tuple[Unigram, dict[bytes, tuple[int, float]]]] = {}


def count_batch(texts: list[bytes | None], path: str, keep: int = KEPT) -> tuple[list[int], list[int], list[float]]:
    """Pre-tokens, tokens and log score of each text."""
    if path not in _kept:
        _kept[path] = Unigram(path), {}
    model, done = _kept[path]
    if len(done) > keep:
        done.clear()
    split = [t.split() if t else [] for t in texts]
    new = set().union(*split) - done.keys()
    ordered = sorted((WORD_START + w.decode("utf-8", "surrogateescape"), w) for w in new)
    for (_, w), found in zip(ordered, model.counts([s for s, _ in ordered]), strict=True):
        done[w] = found
    pre, n, score = [], [], []
    for words in split:
        found = list(map(done.__getitem__, words))
        pre.append(len(words))
        counts, scores = zip(*found, strict=True) if found else ((), ())
        n.append(sum(counts))
        score.append(float(sum(scores)))
    return pre, n, score


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens, log_score for every row.

    Pre-tokens are the runs of characters other than ASCII white space, each led by
    the vocabulary's word mark. Null and empty texts count zero with score zero.
    Ids may be null or repeat; other columns are ignored; an empty table gives none.
    No shuffle: counting is one pass, and what a worker keeps is bounded.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Pre-tokens of a few megabytes at a time, so that a batch of long texts stays small.
            for part in slices(batch, 1):
                pre, n, score = count_batch(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pre, pa.int64()), pa.array(n, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "log_score"]
                )

    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, log_score double")


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in a column add up to about so many bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def op4_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
