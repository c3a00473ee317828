"""Queries that apply the operators to the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import geometry as G
from ..functions import residues as R
from ..functions import strings as S
from ..functions import tables
from ..operators import chains as C
from ..operators import lookup as L
from ..operators import quantize as Q
from ..operators import report as P
from ..operators import segments as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is any."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


# Points of the embeddings, for the SQL of several queries.
_PTS = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
i AS (SELECT vec_id, v, unnest(range(0, len(v) // 3)) AS pos FROM e),
p AS (SELECT vec_id, pos, v[pos * 3 + 1] AS x, v[pos * 3 + 2] AS y, v[pos * 3 + 3] AS z FROM i)
"""

_TORSION = (
    _PTS
    + """,
q AS (SELECT vec_id, pos, x, y, z, lead(x, 1) OVER w x1, lead(y, 1) OVER w y1, lead(z, 1) OVER w z1, lead(x, 2) OVER w x2, lead(y, 2) OVER w y2,
  lead(z, 2) OVER w z2, lead(x, 3) OVER w x3, lead(y, 3) OVER w y3, lead(z, 3) OVER w z3 FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY pos)),
d AS (SELECT vec_id, pos, x1 - x ax, y1 - y ay, z1 - z az, x2 - x1 bx, y2 - y1 byy, z2 - z1 bz, x3 - x2 cx, y3 - y2 cy, z3 - z2 cz FROM q WHERE x3 IS NOT NULL),
u AS (SELECT *, ay * bz - az * byy ux, az * bx - ax * bz uy, ax * byy - ay * bx uz, byy * cz - bz * cy vx, bz * cx - bx * cz vy, bx * cy - byy * cx vz FROM d),
t AS (SELECT vec_id, pos, (ux * vx + uy * vy + uz * vz) / sqrt((ux * ux + uy * uy + uz * uz) * (vx * vx + vy * vy + vz * vz)) AS c,
  ux * (vy * bz - vz * byy) + uy * (vz * bx - vx * bz) + uz * (vx * byy - vy * bx) AS s FROM u),
tor AS (SELECT vec_id, pos, CASE WHEN s < 0 THEN -degrees(acos(greatest(-1, least(1, c)))) ELSE degrees(acos(greatest(-1, least(1, c)))) END AS torsion FROM t)
"""
)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def p01_backbone_filter(spark, sf_dir):
    return M.backbone(_table(spark, sf_dir, "events"), "event_type", ("click", "view", "purchase")).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
WHERE event_type IS DISTINCT FROM b""")
def p04_adjacent_dedupe(spark, sf_dir):
    return M.drop_adjacent_repeats(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events)
WHERE event_type IS DISTINCT FROM a OR event_type = 'view'""")
def p03_lead_dedupe(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return M.drop_before_repeat(rows, ["user_id"], ["event_id"], "event_type", F.col("event_type") == "view")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 5 AND l_returnflag IN ('A', 'R')")
def p06_index_range(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").filter((F.col("l_linenumber") >= 2) & (F.col("l_linenumber") < 5) & F.col("l_returnflag").isin("A", "R"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""SELECT user_id, coalesce(arg_min(value, event_id) FILTER (event_type = 'purchase'), 0.0) AS first_value FROM events GROUP BY user_id""")
def p07_first_by_name(spark, sf_dir):
    value = F.min_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(value, F.lit(0.0)).alias("first_value"))


@query("""SELECT user_id, max(event_id) AS last_id, arg_max(event_type, event_id) = 'purchase' AS ends_so FROM events GROUP BY user_id""")
def p09_last_row_test(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_id"), (F.max_by("event_type", "event_id") == "purchase").alias("ends_so"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
g AS (SELECT *, CASE WHEN l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 1 THEN 1 ELSE 0 END AS gap FROM d)
SELECT l_orderkey, l_linenumber FROM g QUALIFY sum(gap) OVER (PARTITION BY l_orderkey) = 0""")
def p10_only_continuous(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return M.only_whole(M.gap_fragments(rows, ["l_orderkey"], ["l_linenumber"], "l_linenumber"), ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("""WITH r AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run_id FROM r)
SELECT conv_id, CAST(run_id AS BIGINT) AS run_id, any_value(role) AS role, coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS piece FROM n GROUP BY conv_id, run_id""")
def p15_split_by_chain(spark, sf_dir):
    return M.split_text_runs(_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", "text")


@query("""WITH r AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run_id FROM r)
SELECT CAST(conv_id AS VARCHAR) AS text, CAST(run_id AS BIGINT) AS run_id, any_value(role) AS chain, coalesce(string_agg(text, chr(10) ORDER BY turn), '') AS piece FROM n GROUP BY conv_id, run_id""")
def x06_split_in_sql(spark, sf_dir):
    """The split as a table function of SQL, a text in each partition."""
    tables.register(spark)
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("text"), "turn", F.col("role").alias("chain"), F.col("text").alias("text_line"))
    return spark.sql("SELECT * FROM split_by_chain(TABLE({lines}) PARTITION BY text ORDER BY turn)", lines=rows)


@query("""SELECT vec_id, [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, len(embedding) + 1) IF (i - 1) % 3 = 0] AS xs,
CAST(len([i FOR i IN range(1, len(embedding) + 1) IF (i - 1) % 3 = 1]) AS INTEGER) AS n_y FROM embeddings""")
def p17_modulo_split(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return _table(spark, sf_dir, "embeddings").select("vec_id", M.every_third(v, 0).alias("xs"), F.size(M.every_third(v, 1)).alias("n_y"))


_IDS = ["Customer#000000007", "Customer#000000003", "Customer#000000007", "Customer#000000042", "nobody"]
_IDS_SQL = ", ".join(f"({k}, '{n}')" for k, n in enumerate(_IDS))


def _ids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_IDS)), "ord int, name string")


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))


@query(f"SELECT i.ord, i.name, c.c_custkey AS key FROM (VALUES {_IDS_SQL}) i(ord, name) LEFT JOIN customer c ON c.c_name = i.name")
def j01_name_key(spark, sf_dir):
    return L.names_to_keys(_ids(spark), _lookup(spark, sf_dir)).select("ord", "name", "key")


@query("SELECT o_orderkey, o_custkey + 100 AS key, coalesce(c_name, '') AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 100")
def j03_key_name(spark, sf_dir):
    """Keys are moved on by a hundred, so that the last ones have no name."""
    return L.keys_to_names(_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 100).alias("key")), _lookup(spark, sf_dir))


@query(f"SELECT i.ord, i.name, c.c_custkey AS key FROM (VALUES {_IDS_SQL}) i(ord, name) JOIN customer c ON c.c_name = i.name")
def j04_id_subset(spark, sf_dir):
    return L.subset(_ids(spark), _lookup(spark, sf_dir), "name").select("ord", "name", "key")


@query(f"SELECT i.ord, i.name FROM (VALUES {_IDS_SQL}) i(ord, name) WHERE i.name NOT IN (SELECT c_name FROM customer)")
def j04_missing(spark, sf_dir):
    return L.missing(_ids(spark), _lookup(spark, sf_dir), "name").select("ord", "name")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, d.label FROM lineitem
LEFT JOIN (VALUES ('A', 'accepted'), ('N', 'none'), ('R', 'returned')) d(flag, label) ON d.flag = l_returnflag""")
def j05_dictionary_join(spark, sf_dir):
    names = spark.createDataFrame([("A", "accepted"), ("N", "none"), ("R", "returned")], "l_returnflag string, label string")
    return L.with_dictionary(_table(spark, sf_dir, "lineitem"), names, "l_returnflag", strict=True).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "label")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each embedding beside those of the next one; every seventh has lost its last point on that side."""
    points = _points(spark, sf_dir)
    after = points.withColumn("vec_id", F.col("vec_id") - 1).filter("vec_id % 7 <> 3 or pos < 20")
    pairs = L.zip_rows(points, after, ["vec_id"], ["pos"])
    return pairs.select("vec_id", (F.col("place") - 1).alias("pos"), "left", "right", F.col("left.coord").alias("a"), F.col("right.coord").alias("b"))


_PAIR_SQL = _PTS + """, o AS (SELECT vec_id - 1 AS vec_id, pos, x, y, z FROM p WHERE (vec_id - 1) % 7 <> 3 OR pos < 20),
j AS (SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, coalesce(a.pos, b.pos) AS pos, a.pos IS NOT NULL AS one, b.pos IS NOT NULL AS two, (a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2 AS d2
FROM p a FULL JOIN o b ON b.vec_id = a.vec_id AND b.pos = a.pos)"""
_PAIR_ERROR = """CASE WHEN count(*) FILTER (one) = 0 THEN 'the first has no atoms' WHEN count(*) FILTER (two) = 0 THEN 'the second has no atoms'
WHEN count(*) FILTER (one) <> count(*) FILTER (two) THEN 'the numbers of atoms differ: ' || count(*) FILTER (one) || ' and ' || count(*) FILTER (two) END"""


@query(_PAIR_SQL + " SELECT vec_id, count(*) FILTER (one) AS n_first, count(*) FILTER (two) AS n_second, CASE WHEN count(*) FILTER (one AND two) = count(*) THEN round(sqrt(avg(d2)), 6) END AS rmsd FROM j GROUP BY vec_id")
def j08_zip_rmsd(spark, sf_dir):
    """Distances where both sides have as many points; the first and the last embedding have a side alone."""
    d = G.minus(F.col("a"), F.col("b"))
    held = _pairs(spark, sf_dir).withColumn("d2", G.dot(d, d))
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    counts = [F.count_if(F.col(s).isNotNull()).alias(n) for s, n in (("left", "n_first"), ("right", "n_second"))]
    return held.groupBy("vec_id").agg(*counts, F.when(F.bool_and(both), F.round(P.rmsd(F.col("d2")), 6)).alias("rmsd"))


@query(_PAIR_SQL + f""", g AS (SELECT vec_id, {_PAIR_ERROR} AS error, CAST(count(*) FILTER (pos % 7 < 3) // 3 AS BIGINT) AS n_residue, count(*) AS n_atom,
round(sqrt(avg(d2) FILTER (pos % 7 < 3)), 6) AS backbone_rmsd, round(sqrt(avg(d2)), 6) AS all_rmsd FROM j GROUP BY vec_id)
SELECT vec_id, error, CASE WHEN error IS NULL THEN n_residue ELSE 0 END AS n_residue, CASE WHEN error IS NULL THEN n_atom ELSE 0 END AS n_atom,
CASE WHEN error IS NULL THEN backbone_rmsd END AS backbone_rmsd, CASE WHEN error IS NULL THEN all_rmsd END AS all_rmsd FROM g""")
def a05_rmsd_report(spark, sf_dir):
    d, backbone = G.minus(F.col("a"), F.col("b")), F.col("pos") % 7 < 3
    out = P.rmsd_report(_pairs(spark, sf_dir), ["vec_id"], G.dot(d, d), (backbone & F.col("left").isNotNull(), backbone & F.col("right").isNotNull()))
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_residue", "n_atom")}
    return out.withColumns(counts | {c: F.round(c, 6) for c in ("backbone_rmsd", "all_rmsd")})


@query(_PAIR_SQL + " SELECT round(sqrt(avg(d2)), 6) AS rmsd, count(*) FILTER (one AND two) AS n FROM j")
def a04_rmsd(spark, sf_dir):
    d = G.minus(F.col("a"), F.col("b"))
    return _pairs(spark, sf_dir).filter("left is not null and right is not null").agg(F.round(P.rmsd(G.dot(d, d)), 6).alias("rmsd"), F.count(F.lit(1)).alias("n"))


@query("""SELECT l_suppkey, lo, hi, 255 AS n_bin, round(255 / (hi - lo), 9) AS disc_f, round((hi - lo) / 255, 6) AS cont_f
FROM (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey)""")
def a01_quantizer_fit(spark, sf_dir):
    out = Q.fit(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 255)
    return out.withColumn("disc_f", F.round("disc_f", 9)).withColumn("cont_f", F.round("cont_f", 6))


_BINS = """WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS v, min(l_extendedprice) OVER w AS lo, max(l_extendedprice) OVER w AS hi
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
q AS (SELECT *, CAST(floor((v - lo) * CASE WHEN hi > lo THEN 255 / (hi - lo) ELSE 0 END + 0.5) AS INTEGER) AS bin, (hi - lo) / 255 AS cont_f FROM b)
"""


@query(_BINS + "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, bin FROM q")
def f08_quantize(spark, sf_dir):
    return Q.quantize(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 255).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "bin")


@query(_BINS + "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(lo + bin * cont_f, 4) AS restored FROM q")
def f10_dequantize(spark, sf_dir):
    out = Q.quantize(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 255)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("restored", 4).alias("restored"))


@query(_BINS + "SELECT l_suppkey, round(avg(abs(v - (lo + bin * cont_f))), 4) AS mean_err FROM q GROUP BY l_suppkey")
def a06_mean_err(spark, sf_dir):
    return Q.fit_errors(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 255).select("l_suppkey", F.round("mean_err", 4).alias("mean_err"))


@query(_BINS + "SELECT l_suppkey, round(max(abs(v - (lo + bin * cont_f))), 4) AS max_err FROM q GROUP BY l_suppkey")
def a07_max_err(spark, sf_dir):
    return Q.fit_errors(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 255).select("l_suppkey", F.round("max_err", 4).alias("max_err"))


@query(_TORSION + "SELECT vec_id, pos, round(torsion, 6) AS torsion FROM tor")
def w01_torsion(spark, sf_dir):
    return C.torsions(_points(spark, sf_dir), ["vec_id"], ["pos"]).select("vec_id", "pos", F.round("torsion", 6).alias("torsion"))


@query(_TORSION + "SELECT vec_id, list(round(torsion, 6) ORDER BY pos) AS torsions FROM tor GROUP BY vec_id")
def w01_torsion_array(spark, sf_dir):
    held = _table(spark, sf_dir, "embeddings").select("vec_id", C.torsion_array(C.points_of(F.col("embedding"))).alias("t"))
    return held.select("vec_id", F.transform("t", lambda x: F.round(x, 6)).alias("torsions"))


@query(_TORSION + "SELECT vec_id, pos, CAST(floor((round(torsion, 6) + 180) * (255 / 360.0::DOUBLE)) AS INTEGER) AS bin FROM tor")
def f09_fixed_quantize(spark, sf_dir):
    return w01_torsion(spark, sf_dir).select("vec_id", "pos", Q.fixed_angle_bin(F.col("torsion")).alias("bin"))


@query(_TORSION + "SELECT vec_id, pos, CAST(trunc(round(torsion, 6) * 65536 / 360.0::DOUBLE) AS INTEGER) AS steps FROM tor")
def f11_angle_short(spark, sf_dir):
    return w01_torsion(spark, sf_dir).select("vec_id", "pos", Q.angle_short(F.col("torsion")).alias("steps"))


_LEADS = _PTS + """, q AS (SELECT vec_id, pos, x, y, z, lead(x, 1) OVER w x1, lead(y, 1) OVER w y1, lead(z, 1) OVER w z1, lead(x, 2) OVER w x2, lead(y, 2) OVER w y2,
  lead(z, 2) OVER w z2 FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY pos))
"""


@query(_LEADS + """SELECT vec_id, pos, round(degrees(acos(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1) + (z - z1) * (z2 - z1)) /
sqrt(((x - x1)**2 + (y - y1)**2 + (z - z1)**2) * ((x2 - x1)**2 + (y2 - y1)**2 + (z2 - z1)**2)))), 6) AS angle FROM q WHERE x2 IS NOT NULL""")
def w02_bond_angle(spark, sf_dir):
    return C.bond_angles(_points(spark, sf_dir), ["vec_id"], ["pos"]).select("vec_id", "pos", F.round("angle", 6).alias("angle"))


@query(_LEADS + "SELECT vec_id, pos, round(sqrt((x - x1)**2 + (y - y1)**2 + (z - z1)**2), 6) AS length FROM q WHERE x1 IS NOT NULL")
def w03_bond_length(spark, sf_dir):
    return C.bond_lengths(_points(spark, sf_dir), ["vec_id"], ["pos"]).select("vec_id", "pos", F.round("length", 6).alias("length"))


@query(_LEADS + "SELECT vec_id, pos FROM q WHERE sqrt((x - x1)**2 + (y - y1)**2 + (z - z1)**2) > 0.4")
def w06_breaks(spark, sf_dir):
    return C.breaks(_points(spark, sf_dir), ["vec_id"], ["pos"], 0.4).select("vec_id", "pos")


@query("""WITH e AS (SELECT event_id, user_id // 16 AS part, user_id % 4 AS chain, event_type FROM events),
c AS (SELECT *, CASE WHEN chain IS DISTINCT FROM lag(chain) OVER (PARTITION BY part ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM e),
r AS (SELECT *, sum(s) OVER (PARTITION BY part ORDER BY event_id) - 1 AS segment FROM c)
SELECT event_id, part, chain, CAST(segment AS BIGINT) AS segment FROM r
QUALIFY max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY part, segment ORDER BY event_id) = 1""")
def w04_chain_segments(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.floor(F.col("user_id") / 16).alias("part"), (F.col("user_id") % 4).alias("chain"), "event_type")
    return M.chain_segments(rows, ["part"], ["event_id"], "chain", F.col("event_type") == "view").select("event_id", "part", "chain", "segment")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
g AS (SELECT *, CASE WHEN l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 1 THEN 1 ELSE 0 END AS gap FROM d)
SELECT l_orderkey, l_linenumber, CAST(sum(gap) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS fragment FROM g""")
def w05_gap_fragments(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return M.gap_fragments(rows, ["l_orderkey"], ["l_linenumber"], "l_linenumber").select("l_orderkey", "l_linenumber", "fragment")


_RUNS = """WITH c AS (SELECT event_id, user_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS s
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
"""


@query(_RUNS + "SELECT event_id, user_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS run_id FROM c")
def w07_run_id(spark, sf_dir):
    return M.with_run_id(_table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type").select("event_id", "user_id", "run_id")


@query(_RUNS + "SELECT event_id, user_id, event_type FROM c WHERE s = 1")
def a13_run_heads(spark, sf_dir):
    return M.run_heads(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query(_RUNS + """, r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run_id FROM c)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id, list(event_id ORDER BY event_id) AS events FROM r GROUP BY user_id, run_id""")
def a12_collect_runs(spark, sf_dir):
    runs = M.with_run_id(_table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")
    return runs.groupBy("user_id", "run_id").agg(F.array_sort(F.collect_list("event_id")).alias("events"))


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 4 AS INTEGER) AS number FROM events")
def w08_renumber(spark, sf_dir):
    return M.renumber(_table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], 5).withColumn("number", F.col("number").cast("int"))


# ---------------------------------------------------------------- one chain as long as its table, spread over all tasks


@query("""WITH e AS (SELECT event_id, user_id % 4 AS chain, event_type FROM events),
c AS (SELECT *, CASE WHEN chain IS DISTINCT FROM lag(chain) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM e),
r AS (SELECT *, sum(s) OVER (ORDER BY event_id) - 1 AS segment FROM c)
SELECT event_id, chain, CAST(segment AS BIGINT) AS segment FROM r QUALIFY max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY event_id) = 1""")
def w04_one_chain(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("chain"), "event_type")
    return M.chain_segments(rows, [], ["event_id"], "chain", F.col("event_type") == "view", spread=True).select("event_id", "chain", "segment")


@query("""WITH m AS (SELECT event_id, user_id, event_type = 'click' AS mark, CASE WHEN event_type = 'click' THEN user_id END AS marked FROM events),
b AS (SELECT *, last_value(marked IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
g AS (SELECT event_id, user_id, sum(CASE WHEN mark AND user_id - before > 1 THEN 1 ELSE 0 END) OVER w AS fragment, max(CASE WHEN mark THEN 1 ELSE 0 END) OVER w AS met FROM b WINDOW w AS (ORDER BY event_id))
SELECT event_id, user_id, CAST(fragment AS BIGINT) AS fragment FROM g WHERE met = 1""")
def w05_one_chain(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return M.gap_fragments(rows, [], ["event_id"], "user_id", F.col("event_type") == "click", spread=True).select("event_id", "user_id", "fragment")


@query("""WITH c AS (SELECT event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS s FROM events)
SELECT event_id, CAST(sum(s) OVER (ORDER BY event_id) - 1 AS BIGINT) AS run_id FROM c""")
def w07_one_chain(spark, sf_dir):
    return M.with_run_id(_table(spark, sf_dir, "events").select("event_id", "event_type"), [], ["event_id"], "event_type", spread=True).select("event_id", "run_id")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) + 4 AS number FROM lineitem")
def w08_one_chain(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    return M.renumber(rows, [], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], 5, spread=True).select("l_orderkey", "l_linenumber", "number")


@query("SELECT event_type, list(user_id ORDER BY event_id) AS users FROM events GROUP BY event_type")
def a12_long_lists(spark, sf_dir):
    return M.collected(_table(spark, sf_dir, "events"), ["event_type"], ["event_id"], "user_id", "users", spread=True)


@query("SELECT '>events' || chr(10) || string_agg(upper(left(event_type, 1)), '' ORDER BY event_id) || chr(10) AS record FROM events")
def a17_one_sequence(spark, sf_dir):
    """The letters of all events as the record of one sequence."""
    letters = P.joined(_table(spark, sf_dir, "events"), [], ["event_id"], F.upper(F.substring("event_type", 1, 1)), spread=True)
    return letters.select(P.fasta(F.lit("events"), F.col("data")).alias("record"))


@query("""WITH d AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, CAST(CAST(floor(l_quantity) AS INTEGER) AS VARCHAR) AS t FROM lineitem)
SELECT l_returnflag, string_agg(t, ',' ORDER BY l_orderkey, l_linenumber, l_partkey, t) AS data FROM d GROUP BY l_returnflag""")
def a18_long_strings(spark, sf_dir):
    """Two digits of each of a key's values, joined by commas."""
    digits = F.floor("l_quantity").cast("int").cast("string")
    rows = _table(spark, sf_dir, "lineitem").withColumn("t", digits)
    return P.joined(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "t"], F.col("t"), ",", spread=True)


@query("""WITH n AS (SELECT o_custkey, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, list_concat([CAST(i * (n // (n // 4 + 1)) AS INTEGER) FOR i IN range(0, n // 4 + 1)], [CAST(n - 1 AS INTEGER)]) AS anchors FROM n""")
def w09_anchor_index(spark, sf_dir):
    n = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("o_custkey", M.anchor_indices(F.col("n"), 4).alias("anchors"))


@query("""SELECT vec_id, [(CAST(embedding[i] AS DOUBLE) * (64 - (i - 1)) + CAST(embedding[65 - i] AS DOUBLE) * (i - 1)) / 64 FOR i IN range(1, 65)] AS blended FROM embeddings""")
def w10_blend(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return _table(spark, sf_dir, "embeddings").select("vec_id", M.blend(v, F.reverse(v)).alias("blended"))


@query("SELECT vec_id, CAST(len(embedding) // 3 AS INTEGER) AS points, true AS exact FROM embeddings")
def w11_forward_place(spark, sf_dir):
    """Points measured as lengths, angles and torsions and rebuilt from the first three; how far off the rebuilt ones are at most."""
    p = C.points_of(F.col("embedding"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    n = F.size("p")
    lengths = F.transform(F.sequence(F.lit(2), n - 2), lambda i: G.distance(F.col("p")[i], F.col("p")[i + 1]))
    measured = rows.select("vec_id", "p", lengths.alias("r"), F.slice(C.angle_array(F.col("p")), 2, n - 3).alias("a"), C.torsion_array(F.col("p")).alias("t"))
    rebuilt = measured.select("vec_id", "p", C.rebuild(F.slice("p", 1, 3), F.col("r"), F.col("a"), F.col("t")).alias("q"))
    worst = F.array_max(F.transform(F.arrays_zip("p", "q"), lambda x: G.distance(x["p"], x["q"])))
    return rebuilt.select("vec_id", F.size("q").alias("points"), (worst < 1e-6).alias("exact"))


@query("SELECT user_id, CAST(count(*) FILTER (event_type IN ('click', 'view', 'purchase')) // 3 AS BIGINT) AS n_residue, count(*) AS n_atom, count(*) FILTER (event_type IN ('click', 'view', 'purchase')) AS n_backbone FROM events GROUP BY user_id")
def a08_counts(spark, sf_dir):
    held = F.col("event_type").isin("click", "view", "purchase")
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(F.count_if(held) / 3).cast("long").alias("n_residue"), F.count(F.lit(1)).alias("n_atom"), F.count_if(held).alias("n_backbone"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_event_type, arg_max(event_type, event_id) AS last_event_type FROM events GROUP BY user_id")
def a09_first_last(spark, sf_dir):
    return P.first_last(_table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""WITH g AS (SELECT user_id, count(*) AS n, coalesce(bool_and(CAST(floor(value / 200) AS INTEGER) = 0), true) AS z,
coalesce(bool_and(CAST(floor(value / 200) AS INTEGER) = 0) FILTER (event_type = 'view'), true) AS zv FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n < 40 THEN 'E_BACKBONE_COUNT_MISMATCH' WHEN n % 7 = 0 THEN 'E_SIDECHAIN_COUNT_MISMATCH' WHEN n % 5 = 0 THEN 'E_TEMP_FACTOR_COUNT_MISMATCH'
WHEN z THEN 'E_EMPTY_BACKBONE_ANGLE' WHEN zv THEN 'E_EMPTY_SIDECHAIN_ANGLE' WHEN n > 90 THEN 'E_EMPTY_TEMP_FACTOR' ELSE 'SUCCESS' END AS code FROM g""")
def a10_validity(spark, sf_dir):
    bin_ = F.floor(F.col("value") / 200)
    g = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), P.all_zero(bin_).alias("z"), P.all_zero(F.when(F.col("event_type") == "view", bin_)).alias("zv"))
    n = F.col("n")
    return g.select("user_id", P.validity(n >= 40, n % 7 != 0, n % 5 != 0, F.col("z"), F.col("zv"), n > 90).alias("code"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean_quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def a16_group_mean(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, string_agg(upper(event_type[1]), '' ORDER BY event_id) AS data FROM events GROUP BY user_id")
def a17_sequence_string(spark, sf_dir):
    return P.joined(_table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.upper(F.substring("event_type", 1, 1)))


@query("SELECT user_id, string_agg(CAST(CAST(least(9, floor(least(100, greatest(0, value)) / 10)) AS INTEGER) AS VARCHAR), '' ORDER BY event_id) AS data FROM events GROUP BY user_id")
def a18_digit_string(spark, sf_dir):
    return P.joined(_table(spark, sf_dir, "events"), ["user_id"], ["event_id"], S.confidence_digits(F.col("value"), 1))


@query("""SELECT event_id, CAST(CAST(least(9, floor(v / 10)) AS INTEGER) AS VARCHAR) || CAST(CAST(floor(v) AS INTEGER) % 10 AS VARCHAR) || '.' || CAST(CAST(floor(v * 10) AS INTEGER) % 10 AS VARCHAR) AS digits
FROM (SELECT event_id, least(100.0::DOUBLE, greatest(0.0::DOUBLE, value)) AS v FROM events)""")
def f20_digits(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", S.confidence_digits(F.col("value"), 3).alias("digits"))


@query("""SELECT event_id, CAST(u // 10 AS VARCHAR) || '.' || CAST(u % 10 AS VARCHAR) AS fixed FROM (SELECT event_id, CAST(floor(value * 10 + 0.5) AS BIGINT) AS u FROM events)""")
def f21_fixed_decimals(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", S.fixed_decimals(F.col("value"), 1).alias("fixed"))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1 AS place FROM part")
def o01_sort_key(spark, sf_dir):
    """The whole table in order, with each row's place."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_name", (-F.col("p_size")).alias("down"))
    return L.keyed_offsets(rows, ["down", "p_partkey"], F.lit(1)).select("p_partkey", "p_name", F.col("key").alias("place"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END,
l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS place FROM lineitem""")
def o05_alt_order(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    rows = rows.withColumn("_k", L.alternate_order(rows, "l_returnflag", ["R", "A"]))
    return M.renumber(rows, ["l_orderkey"], ["_k", "l_linenumber", "l_partkey", "l_suppkey"], 1, "place").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "place")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def o06_limit(spark, sf_dir):
    return _table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").select("event_id", "value").limit(5)


_SELECTED = (0, 5000, -300)


@query("WITH n AS (SELECT l_extendedprice, l_partkey, l_orderkey, row_number() OVER (ORDER BY l_extendedprice, l_partkey, l_orderkey) AS n, count(*) OVER () AS total FROM lineitem) SELECT a.i AS place, l_extendedprice, l_partkey, l_orderkey FROM n JOIN (VALUES "
+ ", ".join(f"({i})" for i in _SELECTED) + ") a(i) ON n = CASE WHEN i < 0 THEN total + i ELSE i END + 1")
def o07_selection(spark, sf_dir):
    """Rows at places of an order, found by counting rows between values of a sample; only some thousand rows are sorted."""
    rows, order = _table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_partkey", "l_orderkey"]
    return L.at_indices(rows, order, _SELECTED, "place", most=3000).select("place", *order)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 17")
def o07_random_access(spark, sf_dir):
    return L.at_index(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 17)


@query("SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier")
def u01_concat(spark, sf_dir):
    names = [_table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"))]
    return names[0].unionByName(names[1])


@query("SELECT doc_id, CAST(97 + 40 * (n_chars // 25 + 2) + strlen(source) + 9 * n_chars + 5 * n_chars AS BIGINT) AS size FROM documents")
def k02_blob_size(spark, sf_dir):
    n = F.col("n_chars")
    size = P.entry_size(F.floor(n / 25) + 2, F.octet_length("source"), n, 5 * n)
    return _table(spark, sf_dir, "documents").select("doc_id", size.cast("long").alias("size"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS key, CAST(sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS BIGINT) AS "offset", strlen(text) AS length FROM documents""")
def k04_db_index(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return L.keyed_offsets(docs, ["doc_id"], F.col("size")).select("doc_id", "key", "offset", "length")


def _fixed_sql(v: str, places: int) -> str:
    k = 10**places
    u = f"CAST(floor(abs({v}) * {k} + 0.5) AS BIGINT)"
    return f"CASE WHEN {v} < 0 AND {u} > 0 THEN '-' ELSE '' END || CAST({u} // {k} AS VARCHAR) || '.' || lpad(CAST({u} % {k} AS VARCHAR), {places}, '0')"


@query(
    _PTS
    + ", t AS (SELECT vec_id, pos, "
    + ", ".join(f"{_fixed_sql(f'{a} * 10', 3)} AS {a}" for a in "xyz")
    + """ FROM p) SELECT vec_id, 'ATOM  ' || lpad(CAST(pos + 1 AS VARCHAR), 5, ' ') || '  CA  ' || 'ALA' || ' A' || lpad(CAST(pos + 1 AS VARCHAR), 4, ' ') || '    '
|| lpad(x, 8, ' ') || lpad(y, 8, ' ') || lpad(z, 8, ' ') || '  1.00' || ' 50.00' || repeat(' ', 10) || ' C' || '  ' AS line FROM t"""
)
def k05_pdb_line(spark, sf_dir):
    c, n = F.col("coord"), F.col("pos") + 1
    line = P.atom_line(n, F.lit("CA"), F.lit("ALA"), F.lit("A"), n, c["x"] * 10, c["y"] * 10, c["z"] * 10, F.lit(50.0))
    return _points(spark, sf_dir).select("vec_id", line.alias("line"))


@query("SELECT doc_id, '>' || source || chr(10) || text || chr(10) AS record FROM documents")
def k06_fasta(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", P.fasta(F.col("source"), F.col("text")).alias("record"))


@query("SELECT doc_id, source || chr(9) || CAST(n_chars AS VARCHAR) || chr(9) || text AS line FROM documents")
def k07_tsv(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", P.tsv(F.col("source"), F.col("n_chars"), F.col("text")).alias("line"))


_CODES = ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(zip(R.NAMES, R.LETTERS, strict=True)))


@query(f"""SELECT p_partkey, c.name, c.letter, CAST(c.i AS INTEGER) AS code FROM part JOIN (VALUES {_CODES}) c(i, name, letter) ON c.i = p_partkey % 24""")
def f12_codes(spark, sf_dir):
    k = (F.col("p_partkey") % 24).cast("int")
    rows = _table(spark, sf_dir, "part").select("p_partkey", R.index_to_three(k).alias("name"))
    return rows.select("p_partkey", "name", R.three_to_one(F.col("name")).alias("letter"), R.three_to_index(F.col("name")).alias("code"))


@query(f"""SELECT p_partkey, c.letter, c.name, CAST(c.i AS INTEGER) AS code FROM part JOIN (VALUES {_CODES}) c(i, name, letter) ON c.i = p_size % 24""")
def f13_letters(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", R.index_to_one((F.col("p_size") % 24).cast("int")).alias("letter"))
    return rows.select("p_partkey", "letter", R.one_to_three(F.col("letter")).alias("name"), R.one_to_index(F.col("letter")).alias("code"))


@query("SELECT page_id, regexp_extract(url, '[^/\\\\]*$', 0) AS base FROM pages")
def f24_base_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", S.base_name(F.col("url")).alias("base"))


@query("SELECT page_id, regexp_replace(url, '\\.[^.]*$', '') AS stem, regexp_extract(url, '\\.([^.]*)$', 1) AS extension FROM pages")
def f25_file_parts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", S.without_extension(F.col("url")).alias("stem"), S.extension(F.col("url")).alias("extension"))


@query("SELECT page_id, starts_with(url, 'https') AS secure, ends_with(url, '1') AS ends FROM pages")
def f26_prefix_suffix(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.startswith("url", F.lit("https")).alias("secure"), F.endswith("url", F.lit("1")).alias("ends"))


@query("SELECT page_id, [x FOR x IN string_split(url, '/') IF x <> ''] AS pieces FROM pages")
def f27_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", S.tokens(F.col("url"), "/").alias("pieces"))


_WORD = """WITH w AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey % 32 r, l_orderkey % 2048 o, l_suppkey % 4096 s, l_partkey % 4096 p,
CAST(l_linenumber % 256 AS BIGINT) a, CAST(floor(l_quantity) AS BIGINT) b, l_orderkey % 256 c FROM lineitem)
"""


def _word_fields(spark, sf_dir) -> DataFrame:
    f = {"r": F.col("l_partkey") % 32, "o": F.col("l_orderkey") % 2048, "s": F.col("l_suppkey") % 4096, "p": F.col("l_partkey") % 4096, "a": F.col("l_linenumber") % 256, "b": F.floor("l_quantity"), "c": F.col("l_orderkey") % 256}
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[v.cast("long").alias(k) for k, v in f.items()])


@query(_WORD + """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, printf('%08X', r * 134217728 + o * 65536 + s * 16 + p // 256) || printf('%08X', (p % 256) * 16777216 + a * 65536 + b * 256 + c) AS word FROM w""")
def b01_pack_word(spark, sf_dir):
    packed = B.word_bytes(*B.pack_word(*map(F.col, "rospabc")))
    return _word_fields(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.hex(packed).alias("word"))


@query(_WORD + """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(r AS INTEGER) residue, CAST(o AS INTEGER) omega, CAST(s AS INTEGER) psi, CAST(p AS INTEGER) phi,
CAST(a AS INTEGER) ca_c_n, CAST(b AS INTEGER) c_n_ca, CAST(c AS INTEGER) n_ca_c FROM w""")
def b02_unpack_word(spark, sf_dir):
    high, low = B.pack_word(*map(F.col, "rospabc"))
    return _word_fields(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", B.unpack_word(high, low).alias("f")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "f.*")


@query("""WITH v AS (SELECT user_id, list(CAST(event_id % 16 AS INTEGER) ORDER BY event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, [CAST(v[i * 2 + 1] * 16 + coalesce(v[i * 2 + 2], 15) AS INTEGER) FOR i IN range(0, (len(v) + 1) // 2)] AS packed, v AS restored FROM v""")
def b05_nibbles(spark, sf_dir):
    v = F.transform(F.array_sort(F.collect_list("event_id")), lambda x: (x % 16).cast("int"))
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(v.alias("v"))
    packed = rows.select("user_id", B.pack_nibbles(F.col("v")).alias("packed"), F.size("v").alias("n"))
    return packed.select("user_id", "packed", B.unpack_nibbles(F.col("packed"), F.col("n")).alias("restored"))


_MESSAGES = ", ".join(f"('{k}', '{v}')" for k, v in P.VALIDITY.items())


@query(ORACLE_SQL["a10_validity"].replace("SELECT user_id, CASE", ", o AS (SELECT user_id, CASE").replace("FROM g", "FROM g)") + f" SELECT user_id, m.message FROM o JOIN (VALUES {_MESSAGES}) m(code, message) USING (code)")
def a11_messages(spark, sf_dir):
    return a10_validity(spark, sf_dir).select("user_id", P.validity_message(F.col("code")).alias("message"))


@query("""SELECT t.event_type, coalesce(list(e.event_id ORDER BY e.event_id) FILTER (e.event_id IS NOT NULL), []) AS held, coalesce(arg_min(e.value, e.event_id), 0.0) AS first_value
FROM (VALUES ('click'), ('view'), ('nothing')) t(event_type) LEFT JOIN events e USING (event_type) GROUP BY t.event_type""")
def a14_lists_by_type(spark, sf_dir):
    types = spark.createDataFrame([("click",), ("view",), ("nothing",)], "event_type string")
    held = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.array_sort(F.collect_list("event_id")).alias("held"), F.min_by("value", "event_id").alias("first_value"))
    out = types.join(held, "event_type", "left")
    return out.select("event_type", F.coalesce("held", F.array().cast("array<bigint>")).alias("held"), F.coalesce("first_value", F.lit(0.0)).alias("first_value"))


@query("SELECT DISTINCT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey")
def o02_lookup_order(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_name", "s_suppkey")


@query(_TORSION + "SELECT vec_id, CAST(pos // 3 AS INTEGER) AS idx, round(max(torsion) FILTER (pos % 3 = 0), 6) AS psi, round(max(torsion) FILTER (pos % 3 = 1), 6) AS omega, round(max(torsion) FILTER (pos % 3 = 2), 6) AS phi FROM tor GROUP BY vec_id, pos // 3")
def k13_torsion_rows(spark, sf_dir):
    t = C.torsion_array(C.points_of(F.col("embedding")))
    zipped = F.arrays_zip(*[M.every_third(t, k).alias(n) for k, n in enumerate(("psi", "omega", "phi"))])
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(zipped).alias("idx", "a"))
    return rows.select("vec_id", "idx", *[F.round(F.col("a")[n], 6).alias(n) for n in ("psi", "omega", "phi")])


@query("""SELECT o.o_orderpriority, round(sum(l.l_quantity) / count(*), 6) AS mean_quantity, round(sum(l.l_discount) / count(*), 6) AS mean_discount
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority""")
def f33_map_means(spark, sf_dir):
    joined = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = joined.groupBy("o_orderpriority").agg(F.create_map(F.lit("q"), F.sum("l_quantity"), F.lit("d"), F.sum("l_discount")).alias("sums"), F.count(F.lit(1)).alias("n"))
    means = sums.select("o_orderpriority", F.transform_values("sums", lambda _, v: v / F.col("n")).alias("m"))
    return means.select("o_orderpriority", F.round(F.col("m")["q"], 6).alias("mean_quantity"), F.round(F.col("m")["d"], 6).alias("mean_discount"))


_SIDES = ", ".join(f"({i}, '{n}', {len(R.dictionary()[n].side) if n in R.dictionary() else 0})" for i, n in enumerate(R.NAMES))


@query(f"SELECT p_partkey, s.name, CAST(s.n AS INTEGER) AS torsions FROM part JOIN (VALUES {_SIDES}) s(i, name, n) ON s.i = p_partkey % 24")
def f19_side_chain_torsions(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", R.index_to_three((F.col("p_partkey") % 24).cast("int")).alias("name"))
    return rows.select("p_partkey", "name", R.side_chain_torsions(F.col("name")).alias("torsions"))


_CONSTANTS = [(r.name, kind, f"{s.before[2]}_{s.name}", v) for r in R.dictionary().values() for s in r.side for kind, v in (("length", s.length), ("angle", s.angle))]


@query("SELECT name, kind, variable, value FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in _CONSTANTS) + ") t(name, kind, variable, value)")
def k17_residue_constants(spark, sf_dir):
    return spark.createDataFrame(_CONSTANTS, "name string, kind string, variable string, value double")


@query("""SELECT user_id, list_reverse(list(event_id ORDER BY event_id)) AS backwards, list(event_id ORDER BY event_id)[2:4] AS piece FROM events GROUP BY user_id""")
def o04_reverse_slice(spark, sf_dir):
    held = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("v"))
    return held.select("user_id", F.reverse("v").alias("backwards"), F.slice("v", 2, 3).alias("piece"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n, first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS head
FROM lineitem""")
def j11_group_value_to_rows(spark, sf_dir):
    from pyspark.sql import Window as W

    over = W.partitionBy("l_orderkey")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return rows.withColumn("n", F.count(F.lit(1)).over(over)).withColumn("head", F.first("l_partkey").over(over.orderBy("l_linenumber", "l_partkey", "l_suppkey")))
