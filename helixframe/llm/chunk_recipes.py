"""Exact duplicate removal by content-defined chunk recipes (built-in functions only).

A text is cut where its own content says so, each chunk gets an identifier that
has been verified against the chunk's bytes over the whole corpus, and texts are
then compared by their ordered identifier lists, which begin with their number of
chunks. Chunk bytes move once, after map-side duplicate removal; whole texts never
move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table, text_of

#: Shortest and longest chunk, in characters. A cut falls before white space that
#: one of CUT_LETTERS follows.
MIN_CHUNK, MAX_CHUNK = 384, 4096
CUT_LETTERS = "bfgjkmpqvwxyz0-9"


def chunks_of(norm, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK):
    """Content-defined chunks of a text, in order; together they are the text. Empty text: none."""
    pattern = rf"(?s).{{{shortest},{longest}}}?(?=\s[{CUT_LETTERS}])|(?s).{{1,{longest}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def chunk_key(chunk, bits: int):
    h = F.xxhash64(chunk)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = MIN_CHUNK,
    longest: int = MAX_CHUNK,
    hash_bits: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty, and all empty texts are equal. Of equal texts the row with the largest
    id stays. Rows that repeat an id within a group each count in group_size and
    are all kept if theirs is the largest. A null id stays only if its group has
    no other. Other columns are ignored, so their names cannot clash. An empty
    table gives an empty result. hash_bits is lowered in tests to force
    identifiers that clash.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_of(text_col)).alias("norm"))
    chunked = base.select("doc_id", "norm", chunks_of(F.col("norm"), shortest, longest).alias("chunks"))

    # Chunk dictionary: distinct chunks with a provisional identifier each. An identifier is
    # verified when only one chunk bears it; the few others get an ordinal besides.
    dictionary = chunked.select(F.explode("chunks").alias("chunk")).select(chunk_key(F.col("chunk"), hash_bits).alias("h"), "chunk").distinct()
    clashing = materialise(dictionary.groupBy("h").count().filter("count > 1").select("h"), "chunk-clashes")

    own = F.transform("chunks", lambda c: chunk_key(c, hash_bits))
    recipes = chunked.select("doc_id", F.concat(F.array(F.size("chunks").cast("long")), own).alias("recipe"), F.sha2("norm", 256).alias("text_sha256"))
    if not clashing.isEmpty():
        marks = _ordinals(chunked, dictionary, clashing, hash_bits)
        marked = F.concat("recipe", F.flatten(F.transform("clashes", lambda c: F.array(c["pos"].cast("long"), c["ordinal"]))))
        recipes = recipes.join(marks, "text_sha256", "left").select("doc_id", F.coalesce(marked, "recipe").alias("recipe"), "text_sha256")
    recipes = materialise(recipes, "recipes")

    # Partial aggregation keeps a large group from meeting in one task; since the groups are a
    # written table, the join back is one that adaptive execution splits.
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups, "recipe-groups")
    return recipes.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.col("recipe")[0].alias("n_chunks"),
    )


def _ordinals(chunked: DataFrame, dictionary: DataFrame, clashing: DataFrame, hash_bits: int) -> DataFrame:
    """text_sha256, clashes: places and ordinals of a text's chunks that share an identifier with others.

    The ordinal ranks the distinct chunks of one identifier, a handful whatever the
    input; the first needs none. Only chunks whose identifier clashes are joined: the
    list of those is short, so that all others go where they are read.
    """
    ranked = dictionary.join(clashing, "h").select("h", "chunk", F.row_number().over(W.partitionBy("h").orderBy("chunk")).cast("long").alias("ordinal"))
    ranked = materialise(ranked.filter("ordinal > 1"), "chunk-ordinals")
    each = chunked.select(F.sha2("norm", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", chunk_key(F.col("chunk"), hash_bits))
    found = each.join(ranked, ["h", "chunk"]).groupBy("text_sha256").agg(F.array_sort(F.collect_set(F.struct("pos", "ordinal"))).alias("clashes"))
    return materialise(found, "clashes")


def op3_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
