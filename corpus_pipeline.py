"""The corpus pipeline: stages applied to documents, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.chunk_recipes import exact_dedup
from helixframe.llm.common import ascii_lower, materialise, table, text_of
from helixframe.llm.minhash_join import near_duplicates
from helixframe.llm.nnls_packing import digests, pack
from helixframe.llm.qda_quality import accepted, trained
from helixframe.llm.temperature_mixing import in_order, mix


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below 0.3.

    Every row is scored by its own text, null as empty, so rows that repeat share
    their fate; ids, null or not, only join the labels. Columns pass as they are.
    """
    return accepted(docs, trained(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z, the document with the largest id stays.

    Null texts are empty ones. A null id stays where its group has no other. Rows that
    repeat that id within the group all stay.
    """
    # A decision is one about an id, which may be null or repeat, and a text.
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    digest = F.sha2(ascii_lower(text_of("text")), 256)
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (digest == F.col("text_sha256")), "left_semi")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, one document with the least id stays; so do all without an id.

    Rows that repeat an id are documents of their own, one of which stays if the class
    is theirs. Null and empty texts are one class.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    # Written, so that a row has the same number whenever it is read.
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    kept = near_duplicates(rows, row_col=row).filter("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of smaller sources, twice at most, in the order of the passes' block permutations; none is lost.

    A null source is the empty one; null and empty texts have no tokens and come once
    for each whole pass over their source. Rows that repeat go together.
    """
    return in_order(mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4096 tokens; one row for each piece.

    Every row is a document of its own, whatever its id; a null text has the end id alone.
    """
    return digests(pack(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Scores, similarity classes and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs
