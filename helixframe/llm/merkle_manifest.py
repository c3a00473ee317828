"""Merkle manifest of a dataset by lag and lead windows.

Rows are leaves in an order within groups. On each level a node stands on the row
of its first leaf; lags and leads of a fixed offset, masked by the node's slot in
its run and by the run's length, are its siblings, and first children hash their
run. Levels are climbed within blocks of consecutive leaves, so that no window
holds a whole group, and the blocks' tops are the leaves of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run, and levels climbed within one block.
ARITY, LEVELS = 2, 8


def encoded(value: Column) -> Column:
    """A field as a leaf holds it: - for null, else its UTF-8 bytes' count, a colon and its text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(values: list[Column]) -> Column:
    return digest(*map(encoded, values))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (key, order, hash and others) with idx, the place from 0 within the key by order and hash, and n, the key's rows.

    Ranges of the order are numbered on their own and start after the rows of the
    ranges before, so that a key with most rows is spread like any other. Rows alike
    in key, order and hash are parted by a number of their own.
    """
    order = ["order", "hash", "_own"]
    ranged = rows.withColumn("_own", F.monotonically_increasing_id()).repartitionByRange("key", *order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "merkle-leaves")
    totals = ranged.groupBy("_range", "key").agg(F.count(F.lit(1)).alias("_rows"))
    by_key = W.partitionBy("key")
    before = F.sum("_rows").over(by_key.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select("_range", "key", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(by_key).alias("n"))
    own = F.row_number().over(W.partitionBy("_range", "key").orderBy(*order)) - 1
    out = ranged.withColumn("_place", own).join(totals, ["_range", "key"])
    return out.withColumn("idx", (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_own", "_place", "_before")


def climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """nodes (key, idx, n, hash and others) with block, path and top.

    path has left and right, the siblings' digests on either side joined, of each
    level that the key's tree has within the block; top, on a block's first row alone,
    is the digest of the block.
    """
    size = arity**levels
    over = W.partitionBy("key", "block").orderBy("idx")
    rows = nodes.withColumn("block", F.floor(F.col("idx") / size)).withColumn("top", F.col("hash"))
    filled = None
    for level in range(levels):
        stride = arity**level
        slot = F.floor(F.col("idx") / stride) % arity
        near = {f"_lag{k}": F.lag("top", k * stride).over(over) for k in range(1, arity)} | {f"_lead{k}": F.lead("top", k * stride).over(over) for k in range(1, arity)}
        rows = rows.withColumns(near | (filled or {}))
        left = F.concat(*[F.when(slot >= k, F.coalesce(f"_lag{k}", F.lit(""))).otherwise("") for k in range(arity - 1, 0, -1)])
        right = F.concat(*[F.when(slot < arity - k, F.coalesce(f"_lead{k}", F.lit(""))).otherwise("") for k in range(1, arity)])
        beside = F.when(F.col("idx") % stride == 0, F.struct(left.alias("left"), right.alias("right")))
        # A key that has one node left on this level is done: its digest rises as it is.
        parent = F.when(F.col("n") > stride, digest(F.col("top"), right)).otherwise(F.col("top"))
        rows = rows.withColumns({f"_at{level}": beside, "top": F.when(F.col("idx") % (stride * arity) == 0, parent)}).drop(*near)
        # A node's siblings are those of all leaves below it.
        filled = {f"_at{level}": F.last(f"_at{level}", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, 0))}
    rows = rows.withColumns(filled)
    steps = F.array(*[F.when(F.col("n") > arity**level, F.col(f"_at{level}")) for level in range(levels)])
    return rows.withColumn("path", F.filter(steps, lambda x: x.isNotNull())).drop(*[f"_at{level}" for level in range(levels)])


def grown(nodes: DataFrame, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Each round's nodes as climbed() has them, and key and hash of the last digests. One number reaches the driver."""
    size, rounds = arity**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        rounds.append(materialise(climbed(nodes, arity, levels), "merkle-round"))
        tops = rounds[-1].filter(F.col("idx") % size == 0)
        nodes = tops.select("key", F.col("block").alias("idx"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("hash"))
        most = -(-most // size)
        if most <= 1:
            return rounds, nodes.select("key", "hash")


def descended(rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The first round's rows with their whole path, which ends in that of ends (key, path and others)."""
    further = [c for c in ends.columns if c not in ("key", "path")]
    above = ends.withColumnRenamed("path", "_above")
    for k, held in enumerate(reversed(rounds)):
        held = held.join(above, "key" if k == 0 else ["key", "block"]).withColumn("path", F.concat("path", "_above")).drop("_above", "block", "top")
        above = held.select("key", F.col("idx").alias("block"), F.col("path").alias("_above"), *further)
    return held


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    arity: int = ARITY,
    levels: int = LEVELS,
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: order's value, the group's as text, idx in the group, leaf, path, subroot and root; and carried columns.

    A leaf is the digest of the row's fields. Leaves of a group ascend by order (null
    first, those alike by digest), every arity of them become the digest of theirs, and
    so on to one, the subroot; subroots, by group (null first, bytewise), become the
    root alike. path has left and right for each level up to the root. Null groups are
    one; null and empty fields differ; texts of any length are hashed whole; repeated
    rows are leaves of their own. Other columns are ignored, whatever their names. An
    empty table gives no rows, and so no root.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    values = [F.col(f"`{f}`") for f in fields]
    extra = list(carried or {})
    leaves = docs.select(key.alias("key"), F.col(f"`{order}`").alias("order"), leaf_digest(values).alias("hash"), *[c.alias(name) for name, c in (carried or {}).items()])
    rounds, subroots = grown(numbered(leaves), arity, levels)
    subroots = subroots.withColumnRenamed("hash", "subroot")
    upper, root = grown(numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("order"), F.col("subroot").alias("hash"))), arity, levels)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    ends = descended(upper, root.select("key", nothing.alias("path"), F.col("hash").alias("root")))
    ends = ends.select(F.col("order").alias("key"), "path", F.col("hash").alias("subroot"), "root")
    return descended(rounds, ends).select(F.col("order").alias(order), F.when(F.col("key") != "", F.expr("substr(key, 2)")).alias(group), "idx", F.col("hash").alias("leaf"), "path", "subroot", "root", *extra)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda up, at: digest(at["left"], up, at["right"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""), 256)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tampered = leaf_digest([more if f == "n_chars" else F.col(f) for f in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    held = manifest(docs, carried={"tampered": F.when(hit, tampered)})
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = held.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(sql: str) -> str:
    return f"CASE WHEN {sql} IS NULL THEN '-' ELSE octet_length(encode(CAST({sql} AS VARCHAR))) || ':' || {sql} END"


def _leaf(changed: dict[str, str]) -> str:
    return "sha256(" + " || ".join(_field(changed.get(f, f)) for f in FIELDS) + ")"


#: Level by level up to the root, and each leaf's siblings looked up by place. crc32 is worked out by its table of 256.
OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) FOR i IN range(256)] AS t
), leaves AS (
  SELECT doc_id, lang, {_leaf({})} AS leaf, {_leaf({"n_chars": "(n_chars + 1)"})} AS tampered,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, any_value(level) + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, idx // 2
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY idx // 2
), root AS (
  SELECT h AS root FROM tops WHERE n = 1
), steps AS (
  SELECT DISTINCT lang, level FROM nodes WHERE n > 1
), lower AS (
  SELECT p.lang, p.idx, list(CASE WHEN (p.idx >> s.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(x.h, '') ORDER BY s.level) AS path
  FROM placed p JOIN steps s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN nodes x ON x.lang IS NOT DISTINCT FROM p.lang AND x.level = s.level AND x.idx = xor(p.idx >> s.level, 1) GROUP BY p.lang, p.idx
), upper AS (
  SELECT r.lang, list(CASE WHEN (r.idx >> s.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(x.h, '') ORDER BY s.level) AS path
  FROM subroots r JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) s ON true LEFT JOIN tops x ON x.level = s.level AND x.idx = xor(r.idx >> s.level, 1) GROUP BY r.lang
), whole AS (
  SELECT p.doc_id, p.leaf, CASE WHEN p.crc % 7 = 0 THEN p.tampered ELSE p.leaf END AS given, r.subroot, root.root,
    list_concat(coalesce(l.path, []), coalesce(u.path, [])) AS path
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang CROSS JOIN root
  LEFT JOIN lower l ON l.lang IS NOT DISTINCT FROM p.lang AND l.idx = p.idx LEFT JOIN upper u ON u.lang IS NOT DISTINCT FROM p.lang
)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(list_prepend('L', path), lambda x: x[2:]), 'string_agg', '')) AS proof_sha256,
  list_reduce(list_prepend(given, path), lambda h, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || h ELSE h || x[2:] END)) AS folded_root,
  list_reduce(list_prepend(given, path), lambda h, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || h ELSE h || x[2:] END)) = root AS verified
FROM whole
"""
