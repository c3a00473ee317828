"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. The class means and
covariances come from sums that Spark gathers over every labelled training row;
the covariances are shrunk to the pooled one and to a multiple of the identity,
factored once, and scores are Mahalanobis log-density differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, with_schema

NAMES = [
    "log_words", "word_length", "distinct_words", "letters", "capitals", "digits", "stops_commas", "symbols",
    "shouts", "log_line", "repeated_lines", "top_word", "short_words", "entropy", "bars", "long_words",
]
D = len(NAMES)
#: Words at which a text's statistics get half their weight against the class odds.
SHORT = 12
#: Labels that are sent to every task, so that statistics for training are those of labelled texts alone; of more labels, all texts' are joined.
FEW_LABELS = 1 << 20


def _byte_classes() -> np.ndarray:
    of = np.zeros((256, 8))
    for c in range(256):
        ch = chr(c)
        of[c, 0] = c >= 128 or ch.isalpha()
        of[c, 1] = c < 128 and ch.isupper()
        of[c, 2] = c < 128 and ch.isdigit()
        of[c, 3] = ch in ".,"
        of[c, 4] = 33 <= c < 127 and not ch.isalnum() and ch not in ".,;:'\"-()?"
        of[c, 5] = ch in "!"
        of[c, 6] = ch in "|"
        of[c, 7] = ch in " \t\n\r\x0b\x0c"
    return of


_CLASSES = _byte_classes()


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """The statistics of each text, in the order of NAMES; a null or empty text gives zeros."""
    out = np.zeros((len(texts), D))
    counts = np.zeros((len(texts), 256))
    for i, b in enumerate(texts):
        if not b:
            continue
        counts[i] = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        words = b.split()
        if not words:
            continue
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        lines = [x for x in b.split(b"\n") if x]
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        out[i, 0] = np.log1p(n)
        out[i, 1] = np.log(sizes.mean())
        out[i, 2] = len(tally) / n ** 0.8
        out[i, 9] = np.log(len(b) / len(lines))
        out[i, 10] = np.sqrt(1 - len(set(lines)) / len(lines))
        out[i, 11] = np.sqrt(max(tally.values()) / n)
        out[i, 12] = np.sqrt((sizes <= 3).mean())
        out[i, 15] = np.sqrt((sizes > 14).mean())
    total = np.maximum(counts.sum(1), 1)
    share = counts @ _CLASSES / total[:, None]
    out[:, 3] = share[:, 0]
    for column, k in ((4, 1), (5, 2), (6, 3), (7, 4), (8, 5), (14, 6)):
        out[:, column] = np.sqrt(share[:, k])
    p = counts / total[:, None]
    out[:, 13] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    return out


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of class 0 and class 1, and the log odds."""

    mean: tuple[np.ndarray, np.ndarray]
    inverse: tuple[np.ndarray, np.ndarray]
    log_det: tuple[float, float]
    log_odds: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher where class 1 is likelier."""
        density = [-0.5 * (((x - m) @ v.T) ** 2).sum(1) - 0.5 * d for m, v, d in zip(self.mean, self.inverse, self.log_det, strict=True)]
        words = np.expm1(x[:, 0])
        weight = words / (words + SHORT)  # a few words are little evidence
        z = np.clip(self.scale * weight * (density[1] - density[0]) + self.log_odds, -60, 60)
        return 1 / (1 + np.exp(-z))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float, ridge: float, scale: float) -> Discriminant:
    """sums: by class the count, the sum of vectors and the sum of outer products. A class without rows takes the other's figures."""
    empty = (0.0, np.zeros(D), np.zeros((D, D)))
    n, s, q = zip(*(sums.get(k, empty) for k in (0, 1)), strict=True)
    if sum(n) == 0:
        n, q = (1.0, 1.0), (np.eye(D), np.eye(D))
    elif 0 in n:
        k = int(n[0] == 0)
        n, s, q = ((n[k],) * 2, (s[k],) * 2, (q[k],) * 2)
    mean = [s[k] / n[k] for k in (0, 1)]
    within = [q[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * within[0] + n[1] * within[1]) / sum(n)
    # Shrinking works on standardised statistics, so that the identity suits each of them.
    deviation = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    inverse, log_det = [], []
    for k in (0, 1):
        cov = ((1 - pool) * within[k] + pool * pooled) / np.outer(deviation, deviation)
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / D, 1e-6) * np.eye(D)
        factor = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(factor) / deviation)
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(tuple(mean), tuple(inverse), tuple(log_det), float(np.log(n[1] / n[0])), scale)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics f0, f1, ... of each text; no other column is read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    names = [f"f{i}" for i in range(D)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(D))], names=["doc_id", *names])

    return rows.mapInArrow(run, with_schema(rows.select("doc_id").schema, ", ".join(f"{n} double" for n in names)))


def held_out(doc_id, folds: int = 5):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", pool: float = 0.2, ridge: float = 0.02, scale: float = 0.5) -> Discriminant:
    """Fit on all labelled rows outside the held-out fold. Two rows of sums reach the driver.

    Rows with a null id or label are left out; a row labelled more than once counts as often.
    """
    y = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    x = stats.filter(~held_out(F.col("doc_id"))).join(y, "doc_id")
    pairs = [(i, j) for i in range(D) for j in range(i, D)]
    rows = x.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(f"f{i}") for i in range(D)]).alias("s"),
        F.array(*[F.sum(F.col(f"f{i}") * F.col(f"f{j}")) for i, j in pairs]).alias("q"),
    )
    sums = {}
    for r in rows.collect():  # one row for each class
        q = np.zeros((D, D))
        for (i, j), v in zip(pairs, r["q"], strict=True):
            q[i, j] = q[j, i] = v
        sums[r["y"]] = (float(r["n"]), np.array(r["s"]), q)
    return fit(sums, pool, ridge, scale)


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """The discriminant of the labelled documents. All of them are used, however many there are."""
    if labels.count() <= FEW_LABELS:
        ids = labels.select(F.col("doc_id").alias("labelled")).distinct()
        docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        docs, id_col, text_col = docs.join(F.broadcast(ids), docs["doc_id"] == ids["labelled"], "left_semi"), "doc_id", "text"
    return train(document_statistics(docs, id_col, text_col), labels)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null texts count as empty; empty texts have all statistics zero and a score as
    any other. A null id counts as the empty string in the fold. Repeated rows
    score alike. An empty table gives none; without labels every score is one half.
    """
    model = trained(docs, labels)
    rows = docs.select("doc_id", text_of("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(statistics(batch.column(1).to_pylist())))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, with_schema(rows.select("doc_id").schema, "score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the model accepts, all columns kept, without a shuffle."""
    flagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), text_of(text_col).cast("binary").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = model.score(statistics(batch.column(1).to_pylist())) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["record"]).filter(pa.array(keep))

    return flagged.mapInArrow(run, flagged.select("record").schema).select("record.*")


def op1_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
