"""Near-duplicate join on word n-gram sets by MinHash banding.

Bands and rows follow from the threshold and a target recall. Band hashes find
candidates; only identifiers move for that. Texts that share a bucket, directly
or by way of others, meet in units of bounded size, where all pairs are verified
on their full n-gram sets. A group of candidates too large for one unit is dealt
into tiles; two of them meet only where a bucket has members in both. Texts so close
to one set that the triangle inequality links them all are counted, not compared.
Pairs are never rows: a unit returns each text's class and number of links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_of

N_GRAM, THRESHOLD, RECALL, BANDS = 5, 0.8, 0.999, 32
#: Texts and n-grams of a tile; a unit has two tiles at most.
TILE, TILE_GRAMS = 256, 1 << 20
#: Word hashes that a task keeps; when full they are dropped and gathered anew.
KEPT = 200_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have for pairs at the threshold to meet with the target recall.

    There are no more than most bands, unless a threshold so low needs more of one row.
    """
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands <= most:
            break
    return bands, rows


def ngrams(text: bytes, n: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-case words. A text of fewer words has one, an empty one none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(cache) > KEPT:
        cache.clear()
    hashes = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def band_hashes(grams: np.ndarray, bands: int, rows: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for each band of a set's MinHash signature."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(low, (x[k : k + 2048, None] * a + b).min(0), out=low)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for part in low.reshape(bands, rows).T:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """row, doc_id, set_key (digest of the n-gram set), grams (its size) and the band hashes (none for an empty set)."""
    source = docs.select("row", "doc_id", text_of("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(bands * rows)
        cache: dict[bytes, int] = {}
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for text in batch.column(2).to_pylist():
                g = ngrams(text, n, cache)
                keys.append(hashlib.sha256(g.tobytes()).digest()[:16])
                sizes.append(len(g))
                hashes.append(band_hashes(g, bands, rows, a, b) if len(g) else [])
            columns = [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "set_key", "grams", "bands"])

    return source.mapInArrow(run, "row long, doc_id long, set_key binary, grams long, bands array<long>")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), the label the least node.

    Labels fall to the least label among neighbours and then jump to their label's
    label, until none changes. Each round is a written table.
    """
    links = materialise(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), f"{tag}-links")
    labels = materialise(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), tag)
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = materialise(stepped.join(roots, "label").select("node", F.least("label", "root").alias("label"), "old"), tag)
        changed = not jumped.filter("label <> old").isEmpty()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def gathered(members: DataFrame, tag: str) -> DataFrame:
    """Connected components of members (node, hub): rows (node, first, label), first the least hub of the node itself.

    A node hangs on its first hub alone and its other hubs are linked with that one,
    so what goes through rounds is links between different hubs, not members. A hub
    that hangs on others has rows as a node of its own.
    """
    hung = materialise(members.groupBy("node").agg(F.min("hub").alias("first"), F.collect_set("hub").alias("hubs")), f"{tag}-hung")
    between = hung.filter(F.size("hubs") > 1).select("first", F.explode("hubs").alias("hub"))
    links = between.filter("first <> hub").select(F.col("hub").alias("a"), F.col("first").alias("b")).distinct()
    labels = components(links, tag).withColumnRenamed("node", "first")
    return hung.select("node", "first").join(labels, "first", "left").select("node", "first", F.coalesce("label", "first").alias("label"))


def _links(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set the least index it is linked with, directly or not, and the documents it is linked with.

    All pairs of one side, or between both sides, by products of incidence matrices
    over the n-grams that more than one set has.
    """
    n = len(sets)
    length = np.array([len(s) for s in sets], np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, right = (np.arange(n),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    common = np.zeros((len(left), len(right)), np.float32)
    width, total = 1024, int(shared.sum())
    for k in range(0, total, width):
        lo, hi = np.searchsorted(column, [k, k + width])
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - k] = 1
        common += m[left] @ m[right].T
    linked = common >= np.float32(threshold) * (length[left][:, None] + length[right][None, :] - common) - 1e-3
    if same:
        np.fill_diagonal(linked, False)
    degree = np.zeros(n, np.int64)
    degree[left] += linked @ sizes[right]
    if not same:
        degree[right] += linked.T @ sizes[left]
    label = np.arange(n)
    while True:  # labels fall along links; a few rounds, as each also jumps
        new = label.copy()
        new[left] = np.minimum(new[left], np.where(linked, label[right][None, :], n).min(1, initial=n))
        new[right] = np.minimum(new[right], np.where(linked, label[left][:, None], n).min(0, initial=n))
        new = new[new]
        if (new == label).all():
            return label, degree
        label = new


def cores(members: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """rep, first and near of members (rep, first, part, own_tiles) of hubs that have several tiles.

    A hub's pivot has the n-grams that more than half of one of its tiles hold. Jaccard
    distances obey the triangle inequality, so texts within half of the greatest
    distance of links from the pivot are all linked with each other. Which set the pivot
    is bears on the time alone.
    """
    held = members.join(texts, "rep")

    def centre(frame: pd.DataFrame) -> pd.DataFrame:
        cache: dict[bytes, int] = {}
        sets = [ngrams(bytes(t), n, cache) for t in frame["text"]]
        grams, times = np.unique(np.concatenate(sets), return_counts=True)
        return pd.DataFrame({"first": [frame["first"][0]], "own_tiles": [frame["own_tiles"][0]], "pivot": [grams[times * 2 > len(sets)].tobytes()]})

    pivots = held.filter("part = 0").groupBy("first").applyInPandas(centre, "first long, own_tiles long, pivot binary")
    pivots = materialise(pivots, "pivots").select(F.col("first").alias("_first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_tiles") - 1)).alias("_part"), "pivot")

    def measure(frame: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"rep": [], "first": [], "near": []})
        pivot = np.frombuffer(given["pivot"][0], np.uint64) if len(given) else np.empty(0, np.uint64)
        cache: dict[bytes, int] = {}
        near = []
        for text in frame["text"]:
            grams = ngrams(bytes(text), n, cache)
            common = int(np.isin(grams, pivot, assume_unique=True).sum())
            union = len(grams) + len(pivot) - common
            near.append(union > 0 and 1 - common / union <= (1 - threshold) / 2 - 1e-9)
        return pd.DataFrame({"rep": frame["rep"], "first": frame["first"], "near": near})

    return held.groupBy("first", "part").cogroup(pivots.groupBy("_first", "_part")).applyInPandas(measure, "rep long, first long, near boolean")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = N_GRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    tile: int = TILE,
    tile_grams: int = TILE_GRAMS,
    row_col: str | None = None,
    sign: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, copy_of, class_id, n_links; with row_col also row and kept.

    copy_of is the least id with the same n-gram set; class_id the least id of all
    that links join, directly or not; n_links the number of other rows whose sets
    have a Jaccard similarity of at least the threshold. Words are split at white
    space and A-Z lower-cased. A text of fewer than n words has them all as its one
    n-gram. Empty and null texts are alike, link with each other and with nothing
    else. Rows that repeat an id are texts of their own. Rows with a null id are left
    apart: class null, no links. row_col names a column of distinct numbers in a
    written table; kept is true for one row of each class, one with the least id, and
    for all rows left apart. sign: other signatures of the same sets, in
    columns as signatures() has them. Other columns are ignored. Empty in, empty out.
    """
    bands, rows = choose_bands(threshold, recall)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    # An id is its row's key only where none repeats.
    by_row = bool(row_col) or not given.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    if not row_col:
        given = materialise(given.withColumn("row", F.monotonically_increasing_id()), "rows") if by_row else given.withColumn("row", F.col("doc_id"))
    plain = given.filter("doc_id is not null")
    named = materialise(sign(plain) if sign else signatures(plain, n, bands, rows), "signatures")
    copies = materialise(
        named.groupBy("set_key").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("grams").alias("grams"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "row")).alias("first")), "copies"
    )

    # A bucket's least member is its hub, found by partial aggregation.
    places = copies.select("rep", F.explode("bands").alias("bucket"))
    hubs = places.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialise(places.join(hubs, "bucket").select(F.col("rep").alias("node"), "hub", "bucket"), "places")
    groups = gathered(shared, "candidates").join(copies.select(F.col("rep").alias("node"), "grams"), "node")
    groups = materialise(groups, "groups")

    # Units of bounded size: a group of candidates, or two tiles of a large one.
    def tiles_of(by: list[str], name: str) -> DataFrame:
        parts = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("grams") / tile_grams)).cast("long")
        return groups.groupBy(*by).agg(parts.alias(name))

    placed = groups.join(tiles_of(["label"], "tiles"), "label")
    small = placed.filter("tiles = 1").select(F.col("node").alias("rep"), "label", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0).alias("side"))
    large = placed.filter("tiles > 1").join(tiles_of(["label", "first"], "own_tiles"), ["label", "first"])
    large = materialise(large.select(F.col("node").alias("rep"), "label", "first", "tiles", "own_tiles", F.pmod(F.xxhash64("node"), F.col("own_tiles")).alias("part")), "large")
    texts = plain.select(F.col("row").alias("rep"), text_of("text").cast("binary").alias("text"))
    units, core = small, None
    if not large.isEmpty():
        core = materialise(cores(large.filter("own_tiles > 1").select("rep", "first", "part", "own_tiles"), texts, n, threshold), "cores")
        # Members of one hub stay together, in tiles of their own where they are many.
        spread = F.xxhash64(F.lit(2), "first", F.coalesce("near", F.lit(False)), "part")
        own = F.when(F.col("own_tiles") > 1, spread).otherwise(F.xxhash64(F.lit(1), "label", F.pmod(F.xxhash64("first"), F.col("tiles"))))
        large = large.join(core.select("rep", "near"), "rep", "left")
        large = materialise(large.select("rep", "label", own.alias("own"), F.when(F.col("near"), F.col("first")).alias("core")), "tiles")
        core = core.filter("near").select("rep", "first").join(copies.select("rep", "size"), "rep")
        there = shared.join(large, F.col("node") == F.col("rep")).groupBy("bucket", "label").agg(F.collect_set(F.when(F.col("core").isNull(), F.col("own"))).alias("outer"), F.collect_set(F.when(F.col("core").isNotNull(), F.struct("core", "own"))).alias("inner"))
        # All texts of one core are linked: its tiles need not meet each other.
        everyone = F.concat("outer", F.transform("inner", lambda x: x["own"]))
        pairs = there.select("label", F.explode("outer").alias("a"), everyone.alias("others")).select("label", "a", F.explode("others").alias("b"))
        apart = there.filter(F.array_max(F.transform("inner", lambda x: x["core"])) > F.array_min(F.transform("inner", lambda x: x["core"])))
        apart = apart.select("label", F.explode("inner").alias("x"), "inner").select("label", F.col("x.own").alias("a"), F.explode(F.filter("inner", lambda y: y["core"] > F.col("x.core"))).alias("y"))
        pairs = pairs.unionByName(apart.select("label", "a", F.col("y.own").alias("b")))
        met = materialise(pairs.select("label", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "met")
        low = large.join(met.withColumn("own", F.col("low")), ["label", "own"]).select("rep", "label", "low", "high", F.lit(0).alias("side"))
        high = large.join(met.filter("low <> high").withColumn("own", F.col("high")), ["label", "own"]).select("rep", "label", "low", "high", F.lit(1).alias("side"))
        units = small.unionByName(low).unionByName(high)
    held = units.join(copies.select("rep", "size"), "rep").join(texts, "rep")

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", ignore_index=True)
        cache: dict[bytes, int] = {}
        sets = [ngrams(bytes(t), n, cache) for t in frame["text"]]
        label, degree = _links(sets, frame["size"].to_numpy(), frame["side"].to_numpy(), bool(frame["low"][0] == frame["high"][0]), threshold)
        reps = frame["rep"].to_numpy()
        return pd.DataFrame({"rep": reps, "class_id": reps[label], "degree": degree})

    verified = held.groupBy("label", "low", "high").applyInPandas(verify, "rep long, class_id long, degree long")
    if core is not None:
        # Written, so that the join with a large core can be split.
        whole = materialise(core.groupBy("first").agg(F.min("rep").alias("class_id"), F.sum("size").alias("all")), "core-sizes")
        verified = verified.unionByName(core.join(whole, "first").select("rep", "class_id", (F.col("all") - F.col("size")).alias("degree")))
    verified = materialise(verified, "verified")
    degrees = verified.groupBy("rep").agg(F.sum("degree").alias("degree"))
    # A text of one unit has its class there already; one of several units joins their classes.
    joined = gathered(verified.select(F.col("rep").alias("node"), F.col("class_id").alias("hub")), "classes")
    degrees = degrees.join(joined.select(F.col("node").alias("rep"), F.col("label").alias("class_id")), "rep")
    classes = copies.join(degrees, "rep", "left").select(
        "set_key", "first", F.coalesce("class_id", "rep").alias("class"), (F.coalesce("degree", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    if by_row:
        # Written, so that the join with a large class can be split.
        heads = materialise(classes.groupBy("class").agg(F.min("first").alias("head")), "heads")
        classes = classes.join(heads, "class")
    else:
        classes = classes.withColumn("head", F.struct(F.col("class").alias("doc_id"), F.col("class").alias("row")))
    classes = classes.select("set_key", F.col("first.doc_id").alias("copy_of"), F.col("head.doc_id").alias("class_id"), "n_links", F.col("head.row").alias("head"))
    out = named.select("row", "doc_id", "set_key").join(classes, "set_key").withColumn("kept", F.col("row") == F.col("head"))
    apart = given.filter("doc_id is null").select(
        "doc_id", *[F.lit(None).cast("long").alias(c) for c in ("copy_of", "class_id")], F.lit(0).cast("long").alias("n_links"), "row", F.lit(True).alias("kept")
    )
    out = out.select(apart.columns).unionByName(apart)
    return out if row_col else out.drop("row", "kept")


def keep_one(classes: DataFrame) -> Column:
    """True for the document of each class that stays, the one with the least id."""
    return F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id"))


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs of texts that share an n-gram, compared on their whole sets; classes by walking the links.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS grams FROM w
), r AS (
  SELECT grams, min(doc_id) AS rep, count(*) AS size, len(grams) AS n FROM g GROUP BY grams
), e AS (
  SELECT rep, n, size, unnest(grams) AS gram FROM r
), p AS (
  SELECT a.rep AS a, b.rep AS b, any_value(b.size) AS size FROM e a JOIN e b ON a.gram = b.gram AND a.rep <> b.rep
  GROUP BY a.rep, b.rep HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
), reach(node, label) AS (
  SELECT rep, rep FROM r UNION SELECT p.b, reach.label FROM reach JOIN p ON p.a = reach.node WHERE reach.label < p.b
), c AS (
  SELECT node, min(label) AS class_id FROM reach GROUP BY node
), l AS (
  SELECT a, sum(size) AS links FROM p GROUP BY a
)
SELECT g.doc_id, r.rep AS copy_of, c.class_id, CAST(coalesce(l.links, 0) + r.size - 1 AS BIGINT) AS n_links
FROM g JOIN r ON g.grams = r.grams JOIN c ON c.node = r.rep LEFT JOIN l ON l.a = r.rep
"""
