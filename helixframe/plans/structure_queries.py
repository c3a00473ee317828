"""Queries that apply the structure scans, the codec, the databases and whole plans to the driver's tables, with their SQL.

Files, entries and databases are made of the tables' own rows: the points of an
embedding as a text of one chain, its values as the torsions of a chain of 21
residues, names and texts as members of archives and databases.
"""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from .. import api
from ..functions import residues as R
from ..functions import strings as T
from ..operators import chains as C
from ..operators import entry_codec as E
from ..operators import lookup as L
from ..operators import quantize as Q
from ..operators import report as P
from ..operators import segments as M
from ..sources import archive_format
from ..sources import db_format as D
from ..sources import keyed_db as K
from ..sources import structures as S
from ..sources.shared import local_path, materialise, shared_dir, write_files
from . import structures as A
from .queries import _BINS, _PTS, _TORSION, _fixed_sql, _points, _table, query

# ---------------------------------------------------------------- scans of texts that the points of the embeddings make


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _atom_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as atoms N, CA and C in turn, three to a residue, chain A; every sixth embedding goes on in chain B from its fifth residue."""
    c, n = F.col("coord"), F.col("pos")
    rows = _points(spark, sf_dir).filter("coord is not null")
    return rows.select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("name"), F.col("vec_id"), n.cast("long").alias("pos"), (n + 1).alias("serial"), F.element_at(F.array(*map(F.lit, ("N", "CA", "C"))), (n % 3 + 1).cast("int")).alias("atom"),
        F.lit("GLY").alias("residue"), F.when((F.col("vec_id") % 6 == 0) & (n >= 12), "B").otherwise("A").alias("chain"), (F.floor(n / 3) + 1).alias("number"), *((c[k] * 10).alias(k) for k in "xyz"), (F.lit(50.0) + n).alias("temp"),
    )


def _pdb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _atom_rows(spark, sf_dir)
    line = P.atom_line(*(F.col(c) for c in ("serial", "atom", "residue", "chain", "number", "x", "y", "z", "temp")))
    text = P.joined(rows, ["name"], ["pos"], line, "\n", "text")
    return text.select(F.concat("name", F.lit(".pdb")).alias("name"), _bytes(F.concat(F.col("text"), F.lit("\nEND\n"))).alias("content"))


def _read_atoms(rows: DataFrame) -> DataFrame:
    return rows.select("name", "pos", "atom_index", "atom", "residue", "chain", F.col("residue_index").cast("long").alias("residue_index"), "x", "y", "z", "temp_factor")


def _atoms_sql(ending: str) -> str:
    chain = "CASE WHEN vec_id % 6 = 0 AND pos >= 12 THEN 'B' ELSE 'A' END"
    coords = ", ".join(f"CAST({_fixed_sql(f'{a} * 10', 3)} AS DOUBLE) AS {a}" for a in "xyz")
    return _PTS + f"""SELECT 'v' || vec_id || '.{ending}' AS name, CAST(pos AS BIGINT) AS pos, CAST(pos + 1 AS BIGINT) AS atom_index, ['N', 'CA', 'C'][pos % 3 + 1] AS atom, 'GLY' AS residue,
{chain} AS chain, CAST(pos // 3 + 1 AS BIGINT) AS residue_index, {coords}, CAST(50.0 + pos AS DOUBLE) AS temp_factor FROM p"""


@query(_atoms_sql("pdb"))
def s01_pdb_scan(spark, sf_dir):
    return _read_atoms(S.pdb_atoms(_pdb_files(spark, sf_dir)))


_CIF_TAGS = "group_PDB id auth_atom_id label_alt_id auth_comp_id auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z B_iso_or_equiv".split()


@query(_atoms_sql("cif"))
def s02_cif_scan(spark, sf_dir):
    rows = _atom_rows(spark, sf_dir)
    fields = [F.lit("ATOM"), "serial", F.concat(F.lit('"'), "atom", F.lit('"')), F.lit("."), "residue", F.concat(F.lit("'"), "chain", F.lit("'")), "number", *(T.fixed_decimals(F.col(k), 3) for k in "xyz"), T.fixed_decimals(F.col("temp"), 2)]
    text = P.joined(rows, ["name"], ["pos"], F.concat_ws(" ", *fields), "\n", "text")
    head = "data_x # from points\n_entry.id X\nloop_\n" + "".join(f"_atom_site.{t}\n" for t in _CIF_TAGS)
    return _read_atoms(S.atoms(text.select(F.concat("name", F.lit(".cif")).alias("name"), _bytes(F.concat(F.lit(head), "text", F.lit("\n"))).alias("content"))))


@query(_atoms_sql("json"))
def s03_mmjson_scan(spark, sf_dir):
    rows = _atom_rows(spark, sf_dir)
    held = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "serial", "atom", "residue", "chain", "number", *(T.fixed_decimals(F.col(k), 3).alias(k) for k in "xyz"), "temp"))).alias("a"))
    pairs = (("id", "serial"), ("auth_atom_id", "atom"), ("auth_comp_id", "residue"), ("auth_asym_id", "chain"), ("auth_seq_id", "number"), ("Cartn_x", "x"), ("Cartn_y", "y"), ("Cartn_z", "z"), ("B_iso_or_equiv", "temp"))
    block = F.to_json(F.struct(F.struct(F.struct(*[F.col("a")[f].alias(tag) for tag, f in pairs]).alias("atom_site")).alias("data_x")))
    return _read_atoms(S.atoms(held.select(F.concat("name", F.lit(".json")).alias("name"), _bytes(block).alias("content"))))


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows name, content: a gzipped file each, and an archive for each piece of a batch with a folder and all of them."""
    for k, f in enumerate(S.in_pieces(frames)):
        yield pd.DataFrame({"path": "in/" + f["name"] + ".gz", "content": [gzip.compress(bytes(c), mtime=0) for c in f["content"]]})
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as archive:
            folder = tarfile.TarInfo("folder")
            folder.type = tarfile.DIRTYPE
            archive.addfile(folder)
            for n, c in zip(f["name"], f["content"], strict=True):
                info = tarfile.TarInfo(f"folder/{n}")
                info.size = len(c)
                archive.addfile(info, io.BytesIO(bytes(c)))
        yield pd.DataFrame({"path": [f"in/{f['name'].iloc[0]}-{k}.tar.gz"], "content": [out.getvalue()]})


@query(
    """WITH m AS (SELECT 'd' || doc_id || '.txt' AS name, coalesce(text, '') AS text FROM documents)
SELECT name, strlen(text) AS n_bytes, sha256(text) AS digest FROM m UNION ALL SELECT 'folder/' || name, strlen(text), sha256(text) FROM m"""
)
def s13_gzip_and_tar(spark, sf_dir):
    """Files that are gzipped and files in archives, whose folders are left out."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("name"), _bytes(F.coalesce("text", F.lit(""))).alias("content"))
    found = S.opened(docs.mapInPandas(_packed, "path string, content binary"))
    return found.select("name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


_ENDINGS = (".pdb", ".cif.gz", ".mmcif", ".json.gz", ".fcz", ".PDB.gz", ".txt", "")
_NAMED = "WITH f AS (SELECT doc_id, source || '/d.' || doc_id || [" + ", ".join(f"'{e}'" for e in _ENDINGS) + f"][doc_id % {len(_ENDINGS)} + 1] AS path FROM documents), n AS (SELECT doc_id, path, regexp_replace(lower(path), '\\.gz$', '') AS stem FROM f)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/d."), F.col("doc_id"), ending).alias("path"))


@query(_NAMED + " SELECT doc_id, CASE WHEN regexp_matches(stem, '\\.(cif|mmcif)$') THEN 'cif' WHEN stem LIKE '%.json' THEN 'mmjson' WHEN stem LIKE '%.fcz' THEN 'entry' ELSE 'pdb' END AS format FROM n")
def s06_format_by_name(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", S.format_of(F.col("path")).alias("format"))


@query(_NAMED + " SELECT doc_id, path FROM n WHERE regexp_matches(path, '\\.(pdb|cif)(\\.gz)?$')")
def p14_compressible(spark, sf_dir):
    return _named(spark, sf_dir).filter(T.compressible(F.col("path")))


@query(
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, ['', '# note' || chr(10) || chr(10), ' data_', '{', 'FCMP', 'DATA_', '#'][doc_id % 7 + 1] AS head FROM documents)
SELECT doc_id, CASE WHEN head = 'FCMP' THEN 'entry' WHEN head = '{' THEN 'mmjson' WHEN lower(trim(head)) = 'data_' THEN 'cif'
WHEN head IN ('', '# note' || chr(10) || chr(10)) AND regexp_matches(text, '^\\s*\\{') THEN 'mmjson' ELSE 'pdb' END AS format FROM t"""
)
def s07_sniff(spark, sf_dir):
    """Formats told by content, of documents behind various beginnings."""
    heads = F.array(*map(F.lit, ("", "# note\n\n", " data_", "{", "FCMP", "DATA_", "#")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", _bytes(F.concat(F.element_at(heads, (F.col("doc_id") % 7 + 1).cast("int")), F.coalesce("text", F.lit("")))).alias("content"))
    return docs.select("doc_id", S.sniff(F.col("content")).alias("format"))


@query(
    _PTS
    + """SELECT 'v' || vec_id || '.pdb' AS name, CAST(CASE WHEN vec_id % 6 = 0 AND max(pos) >= 12 THEN 2 ELSE 1 END AS BIGINT) AS chains, count(*) AS n_atom,
CASE WHEN vec_id % 6 = 0 AND max(pos) >= 12 THEN 'more than one chain' END AS error FROM p GROUP BY vec_id"""
)
def s08_single_chain(spark, sf_dir):
    return S.single_chain(S.pdb_atoms(_pdb_files(spark, sf_dir))).drop("entry")


@query(
    """WITH d AS (SELECT doc_id, 'dir/' || source || '.' || doc_id AS file, CASE WHEN doc_id % 3 = 0 THEN lang END AS ident, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'T' || doc_id WHEN 2 THEN 'dir/' || source || '.' || doc_id ELSE source || '.' || doc_id END AS title FROM documents),
c AS (SELECT doc_id, file, coalesce(nullif(ident, ''), nullif(title, ''), file) AS found FROM d)
SELECT doc_id, CASE WHEN found = regexp_extract(file, '[^/]*$') THEN regexp_replace(regexp_extract(file, '[^/]*$'), '\\.[^.]*$', '') ELSE found END AS title FROM c"""
)
def s09_title(spark, sf_dir):
    d, name = _table(spark, sf_dir, "documents"), F.concat(F.col("source"), F.lit("."), F.col("doc_id"))
    file, k = F.concat(F.lit("dir/"), name), F.col("doc_id") % 4
    ident = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    text = F.when(k == 0, "").when(k == 1, F.concat(F.lit("T"), F.col("doc_id"))).when(k == 2, file).otherwise(name)
    return d.select("doc_id", S.title(ident, text, file).alias("title"))


@query("SELECT 'v' || vec_id || '.json' AS name, CASE vec_id % 3 WHEN 0 THEN 'id' || vec_id WHEN 1 THEN 'the title ' || vec_id ELSE 'v' || vec_id END AS title FROM embeddings")
def s09_titles_of_texts(spark, sf_dir):
    """Titles as texts have them: an entry's id, else a title, else the file's name."""
    v = F.col("vec_id")
    items = F.when(v % 3 == 0, F.concat(F.lit('"entry": {"id": ["id'), v, F.lit('"]}'))).when(v % 3 == 1, F.concat(F.lit('"struct": {"title": ["the title '), v, F.lit('"]}'))).otherwise("")
    texts = _table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), v, F.lit(".json")).alias("name"), _bytes(F.concat(F.lit('{"data_x": {'), items, F.lit("}}"))).alias("content"))
    return S.titles(texts).select("name", "title")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type || '.txt' AS name, value AS angle, count(*) AS n FROM events GROUP BY event_type, value")
def s25_torsion_text(spark, sf_dir):
    """Numbers written as text, a line each between lines that are none, and read again: the values read, as often as they were read, by file."""
    path = _scratch(spark, "torsions")
    lines = F.array(F.concat(F.lit(" "), F.col("value").cast("string")), F.lit("no number"), F.lit(""))
    _table(spark, sf_dir, "events").select("event_type", F.concat_ws("\n", lines).alias("value")).write.partitionBy("event_type").text(path)
    read = S.torsion_text(spark, path)
    name = F.concat(F.regexp_extract("path", "event_type=([^/]*)/", 1), F.lit(".txt"))
    return read.groupBy(name.alias("name"), "angle").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- databases of names and of texts


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), _bytes(F.concat_ws("|", "c_name", "c_mktsegment")).alias("content"))


_DB = "WITH d AS (SELECT row_number() OVER (ORDER BY c_name) - 1 AS key, c_name AS name, c_name || '|' || c_mktsegment AS content FROM customer)"


def _written(spark: SparkSession, sf_dir: str) -> str:
    path = _scratch(spark, "db")
    K.write(_customers(spark, sf_dir), path)
    return path


@query(_DB + " SELECT key, name, content FROM d")
def s14_database(spark, sf_dir):
    """A database as written and read again."""
    return K.read(spark, _written(spark, sf_dir)).select("key", "name", F.decode("content", "UTF-8").alias("content"))


@query(_DB + ', a AS (SELECT unnest(range(40)) AS ord) SELECT ord, key, name, content FROM a JOIN d ON d.name = \'Customer#\' || lpad(CAST((ord * 7) % 31 + 1 AS VARCHAR), 9, \'0\')')
def s15_database_by_name(spark, sf_dir):
    """Entries by name, in the order asked for and as often; unknown names are left out."""
    ids = [f"Customer#{(k * 7) % 31 + 1:09d}" for k in range(40)] + ["nobody"]
    return K.read(spark, _written(spark, sf_dir), ids).select("ord", "key", "name", F.decode("content", "UTF-8").alias("content"))


@query(_DB + ", a AS (SELECT unnest(range(25)) AS ord) SELECT ord, key, name, content FROM a JOIN d ON d.key = ord * 5")
def s15_database_by_key(spark, sf_dir):
    return K.read(spark, _written(spark, sf_dir), [k * 5 for k in range(25)] + [10**12], by_key=True).select("ord", "key", "name", F.decode("content", "UTF-8").alias("content"))


@query(_DB + ', l AS (SELECT key, name, strlen(content) AS length, CAST(sum(strlen(content)) OVER (ORDER BY key) - strlen(content) AS BIGINT) AS "offset" FROM d) SELECT key, name, "offset", length FROM l')
def s17_index_and_lookup(spark, sf_dir):
    """The index and the lookup of a written database."""
    path = _written(spark, sf_dir)
    return K.read_index(spark, f"{path}/index").join(K.read_lookup(spark, f"{path}/lookup"), "key").select("key", "name", "offset", "length")


@query(_DB + " SELECT key, name, content || chr(0) AS content FROM d")
def k04_native_database(spark, sf_dir):
    """Plain files, each task writing its own ranges of them, read again."""
    path = local_path(_scratch(spark, "native"))
    K.write_native(_customers(spark, sf_dir), path, ended=True)
    return K.read_native(spark, path).select("key", "name", F.decode("content", "UTF-8").alias("content"))


def _native(spark: SparkSession, sf_dir: str) -> str:
    path = local_path(_scratch(spark, "native"))
    K.write_native(_customers(spark, sf_dir), path)
    return path


@query(_DB + " SELECT key, name, content FROM d")
def s14_format(spark, sf_dir):
    """Written and read as a Spark format, by ranges of the index."""
    rows = D.load(spark, _native(spark, sf_dir), split=4096)
    return rows.select("key", "name", F.decode("content", "UTF-8").alias("content"))


@query(_DB + " SELECT key, name, content FROM d WHERE key % 3 = 1 AND key < 100 OR key IN (120, 130)")
def s15_format_by_key(spark, sf_dir):
    """Entries of keys, of which tasks read the ranges of the index that have them."""
    keys = [k for k in range(100) if k % 3 == 1] + [120, 130, 10**12]
    rows = D.load(spark, _native(spark, sf_dir), keys=keys, split=4096)
    return rows.select("key", "name", F.decode("content", "UTF-8").alias("content"))


@query(_DB + " SELECT key, name, content FROM d WHERE name LIKE '%7' AND name <= 'Customer#000000100'")
def s15_format_by_name(spark, sf_dir):
    rows = D.load(spark, _native(spark, sf_dir), names=[f"Customer#{k:09d}" for k in range(7, 101, 10)], strict=True)
    return rows.select("key", "name", F.decode("content", "UTF-8").alias("content"))


@query(_DB + ', l AS (SELECT key, strlen(content) AS length, CAST(sum(strlen(content)) OVER (ORDER BY key) - strlen(content) AS BIGINT) AS "offset" FROM d) SELECT o_orderkey, coalesce("offset", -1) AS "offset", coalesce(length, 0) AS length FROM orders LEFT JOIN l ON key = o_custkey')
def j02_key_to_offset(spark, sf_dir):
    """Every order's customer number looked up as a key; the last one has no entry."""
    index = L.keyed_offsets(_customers(spark, sf_dir), ["name"], F.octet_length("content"))
    keys = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return L.locate(keys, index).select("o_orderkey", "offset", "length")


@query(_DB + " SELECT key, name FROM d WHERE key = 42")
def j12_row_of_key(spark, sf_dir):
    return L.by_key(K.read_lookup(spark, f"{_written(spark, sf_dir)}/lookup"), 42).select("key", "name")


@query("SELECT count(*) AS entries FROM customer")
def a21_database_size(spark, sf_dir):
    return spark.range(1).select(F.lit(len(K.Database(spark, _written(spark, sf_dir)))).cast("long").alias("entries"))


@query("SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS lines FROM documents")
def a20_line_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("lines"))


@query(
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events), n AS (SELECT count(*) AS n FROM events),
r AS (SELECT i AS part, i * 900 AS begin_at, least(i * 900 + 500, n) AS end_at FROM n, unnest(range(n // 900 + 1)) AS u(i)) SELECT event_id, part FROM o JOIN r ON pos >= begin_at AND pos < end_at"""
)
def p19_slices(spark, sf_dir):
    """Rows in half-open ranges of places."""
    events = _table(spark, sf_dir, "events").withColumn("pos", F.col("event_id") - F.lit(_table(spark, sf_dir, "events").agg(F.min("event_id")).first()[0]))
    n = events.count()
    ranges = spark.range(n // 900 + 1).select(F.col("id").alias("part"), (F.col("id") * 900).alias("begin"), F.least(F.col("id") * 900 + 500, F.lit(n)).alias("end"))
    return L.slices(events, ranges).select("event_id", "part")


# ---------------------------------------------------------------- entries of chains whose torsions are the values of the embeddings

@query(_DB + ', l AS (SELECT key, name, strlen(content) AS length, CAST(sum(strlen(content)) OVER (ORDER BY key) - strlen(content) AS BIGINT) AS "offset" FROM d) SELECT o_orderkey, name, "offset", length FROM orders JOIN l ON key = o_custkey')
def s19_index_cache(spark, sf_dir):
    """Every order's customer number looked up in the index kept as a bucketed table, which a join does not deal out again."""
    index = K.cached_index(spark, _native(spark, sf_dir))
    keys = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return keys.join(index.hint("merge"), "key").select("o_orderkey", "name", "offset", "length")


@query("SELECT 'm' || c_custkey || '/' || repeat('long', CAST(c_custkey % 40 AS INT)) AS name, strlen(c_name) AS n_bytes, sha256(c_name) AS digest FROM customer")
def s13_ranges(spark, sf_dir):
    """An archive read by ranges of members."""
    path = local_path(_scratch(spark, "archive")) + ".tar"
    name = F.concat(F.lit("m"), F.col("c_custkey"), F.lit("/"), F.expr("repeat('long', int(c_custkey % 40))"))
    S.write_archive(_table(spark, sf_dir, "customer").select(name.alias("name"), _bytes(F.col("c_name")).alias("content")), path)
    rows = archive_format.load(spark, path, split=1 << 16)
    return rows.select("name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


_KINDS = [n for n in R.NAMES if n in R.dictionary()][:20]
_KINDS_SQL = ", ".join(f"({k}, '{n}', '{R.LETTERS[R.NAMES.index(n)]}', {len(R.dictionary()[n].atoms)}, {len(R.dictionary()[n].side)})" for k, n in enumerate(_KINDS))
#: Residues of each chain, and of the SQL the residues of each embedding.
_CHAIN = 21
_CHAINS = f"""WITH k(kind, name, letter, atoms, side) AS (VALUES {_KINDS_SQL}), r AS (SELECT vec_id, i, k.* FROM embeddings, unnest(range({_CHAIN})) AS u(i) JOIN k ON kind = (vec_id + i) % {len(_KINDS)}),
c AS (SELECT vec_id, count(*) AS n_residue, sum(atoms) AS n_atom, sum(side) AS n_side, string_agg(letter, '' ORDER BY i) AS sequence FROM r GROUP BY vec_id)"""


def _models(vec_ids: list[int], values: np.ndarray) -> list[E.Atoms]:
    """A chain for each row, of residues of all kinds in turn; its backbone's torsions follow the values, its side chains' are staggered."""
    known = R.dictionary()
    names = [[_KINDS[(v + i) % len(_KINDS)] for i in range(_CHAIN)] for v in vec_ids]
    m, steps = len(vec_ids), _CHAIN - 1
    twist = np.clip(values[:, : 3 * _CHAIN] * 400, -179, 179)[:, : 3 * steps]
    length = np.tile([R.C_N, R.N_CA, R.CA_C], (m, steps, 1))
    length[[[x == "PRO" for x in n[:steps]] for n in names], 1] = R.PRO_N_CA
    angle = np.tile([116.6, 121.4, 111.0], (m, steps))
    start = np.tile([[0.0, 0.0, 0.0], [1.46, 0.0, 0.0], [2.0, 1.42, 0.0]], (m, 1, 1))
    backbone = E._walk(start, length.reshape(m, -1), angle, twist).reshape(-1, 3, 3)
    flat = [x for n in names for x in n]
    coords = E.with_side_chains(backbone, flat, np.array([(-60.0, 180.0, 60.0)[j % 3] for x in flat for j in range(len(known[x].side))]))
    out = []
    for k, own in enumerate(names):
        atoms = [(a, x, i + 1) for i, x in enumerate(own) for a in known[x].atoms]
        atom, residue, number = map(np.array, zip(*atoms, strict=True))
        out.append(E.Atoms(atom, residue, number, np.arange(1, len(atoms) + 1), np.concatenate(coords[k * _CHAIN : (k + 1) * _CHAIN]), 39.0 + number))
    return out


def _chain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 500):
                some = f.iloc[k : k + 500]
                texts = [E.pdb_text(a).encode() for a in _models(some["vec_id"].tolist(), np.stack(some["embedding"]).astype(float))]
                yield pd.DataFrame({"name": [f"c{v}.pdb" for v in some["vec_id"]], "content": texts})

    # Many more bytes come out than go in, so the rows are dealt out first. Written, since a text is read several times: for each format and for its name.
    return materialise(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(32, "vec_id").mapInPandas(run, "name string, content binary"), "files")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.compress_texts(_chain_files(spark, sf_dir))


@query(_CHAINS + f", s AS (SELECT vec_id, n_residue, n_side, 'c' || vec_id AS title FROM c) SELECT title || '.fcz' AS name, CAST(97 + 40 * ({_CHAIN} // 25 + 2) + strlen(title) + 9 * n_residue + n_side AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS error FROM s")
def k01_entry_size(spark, sf_dir):
    """Every chain's entry, whose size follows from its residues, anchors and side chains."""
    return _entries(spark, sf_dir).select("name", F.octet_length("blob").cast("long").alias("size"), "error")


@query(_CHAINS + " SELECT 'c' || vec_id || '.fcz' AS name, 'c' || vec_id AS title, CAST(n_residue AS BIGINT) AS n_residue, sequence, CAST(n_side AS BIGINT) AS n_side, left(sequence, 1) AS first_residue, right(sequence, 1) AS last_residue, 'SUCCESS' AS outcome FROM c")
def s20_entry_fields(spark, sf_dir):
    """The fields that an entry's bytes hold."""
    rows = E.extract(_entries(spark, sf_dir))
    return rows.select("name", "title", F.col("n_residue").cast("long").alias("n_residue"), "sequence", "n_side", "first_residue", "last_residue", "outcome")


@query(_CHAINS + f" SELECT 'c' || vec_id || '.fcz' AS name, string_agg(CAST((40 + i) // 10 AS VARCHAR), '' ORDER BY i) AS digits, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY vec_id")
def p08_confidence_of_entries(spark, sf_dir):
    """One confidence for each residue; bins of whole steps, since the values run evenly."""
    rows = A.extract_plddt(_entries(spark, sf_dir))
    return rows.select("name", F.col("data").alias("digits"), F.col("n_residue").cast("long").alias("n"))


@query(_CHAINS + " SELECT 'c' || vec_id || '.fcz' AS name, CAST(n_residue AS BIGINT) AS n_residue, CAST(n_atom AS BIGINT) AS n_atom, true AS close, true AS backbone_close FROM c")
def w12_round_trip(spark, sf_dir):
    """Atoms placed again from entries, against the texts' own; the distance that quantising leaves is small."""
    files = _chain_files(spark, sf_dir)
    given = S.pdb_atoms(files).withColumn("name", F.regexp_replace("name", "pdb$", "fcz"))
    report = A.compare(given, E.decompress(A.compress_texts(files)), key="name")
    return report.select("name", F.col("n_residue").cast("long").alias("n_residue"), F.col("n_atom").cast("long").alias("n_atom"), (F.col("all_rmsd") < 0.25).alias("close"), (F.col("backbone_rmsd") < 0.15).alias("backbone_close"))


@query(_CHAINS + " SELECT 'c' || vec_id || '.fcz' AS name, name AS residue, CAST(i + 1 AS BIGINT) AS number, CAST(atoms AS BIGINT) AS atoms FROM r")
def w14_side_chains(spark, sf_dir):
    """Atoms of each residue, in number, after decoding."""
    atoms = E.decompress(_entries(spark, sf_dir))
    return atoms.groupBy("name", "residue", F.col("residue_index").cast("long").alias("number")).agg(F.count(F.lit(1)).alias("atoms"))


@query(_CHAINS + " SELECT 'c' || vec_id || '.fcz' AS name, CAST(n_atom + 1 AS BIGINT) AS n_lines, CAST(80 * n_atom AS BIGINT) AS atom_bytes, CAST(NULL AS VARCHAR) AS error FROM c")
def k12_pdb_text(spark, sf_dir):
    """The text of each entry: ATOM records of 80 columns and a TER."""
    text = A.decompress_texts(_entries(spark, sf_dir).select("name", "blob"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    length = F.aggregate(F.filter(lines, lambda x: x.startswith("ATOM")), F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return text.select("name", F.size(lines).cast("long").alias("n_lines"), length.alias("atom_bytes"), "error")


@query(
    "SELECT 'c' || vec_id || '.fcz' AS name, CASE vec_id % 4 WHEN 0 THEN 'has a number of confidence values that differs from its residues' WHEN 1 THEN 'not an entry' WHEN 2 THEN 'no entry' END AS error, vec_id % 4 = 3 AS has_text FROM embeddings"
)
def p11_checked_entries(spark, sf_dir):
    """Entries that are cut short, foreign or missing give rows with errors, whole ones their text."""
    k = F.pmod(F.regexp_extract("name", r"\d+", 0).cast("long"), F.lit(4))
    blob = F.when(k == 0, F.substring(F.col("blob"), F.lit(1), F.octet_length("blob") - 5)).when(k == 1, F.concat(F.lit(bytearray(b"X")), "blob")).when(k == 3, F.col("blob"))
    text = A.decompress_texts(_entries(spark, sf_dir).select("name", blob.alias("blob")), check=True)
    return text.select("name", "error", F.col("text").isNotNull().alias("has_text"))


@query(
    """SELECT CASE vec_id % 5 WHEN 4 THEN 'c' || vec_id || '.fcz' ELSE 'x.fcz' END AS name, 'f' || vec_id AS entry, CASE WHEN vec_id % 5 < 4 THEN 'no atoms that can be encoded' END AS error FROM embeddings"""
)
def p11_inputs_that_are_none(spark, sf_dir):
    """Files of one name in different places, empty, broken, missing or without atoms: a row with an error for each."""
    v = F.regexp_extract("name", r"\d+", 0).cast("long")
    bad = F.element_at(F.array(F.lit(bytearray()), F.lit(bytearray(b"{not json")), F.lit(bytearray(b"HEADER nothing\n")), F.lit(None).cast("binary")), (v % 5 + 1).cast("int"))
    files = _chain_files(spark, sf_dir).select(F.concat(F.lit("f"), v).alias("entry"), F.when(v % 5 == 4, F.col("name")).otherwise(F.lit("x.pdb")).alias("name"), F.when(v % 5 == 4, F.col("content")).otherwise(F.when(v % 5 < 4, bad)).alias("content"))
    return A.compress_texts(files).select("name", "entry", "error")


@query("""WITH e AS (SELECT 'f' || vec_id AS entry, CASE WHEN vec_id % 11 = 5 THEN 'the second has no atoms' WHEN vec_id % 7 = 3 THEN 'the numbers of atoms differ: 21 and 20' END AS error FROM embeddings)
SELECT entry, error, CASE WHEN error IS NULL THEN 7 ELSE 0 END AS n_residue, CASE WHEN error IS NULL THEN 21 ELSE 0 END AS n_atom, CASE WHEN error IS NULL THEN 5.0::DOUBLE END AS backbone_rmsd, CASE WHEN error IS NULL THEN 5.0::DOUBLE END AS all_rmsd FROM e""")
def s26_rmsd_of_files(spark, sf_dir):
    """Structures against themselves moved by three and four. Every fifth file has the same name, every seventh loses an atom, and some have no other side."""
    v = F.regexp_extract("name", r"\d+", 0).cast("long")
    named = F.when(v % 5 == 0, "same.pdb").otherwise(F.col("name"))
    atoms = S.pdb_atoms(_pdb_files(spark, sf_dir).select(F.concat(F.lit("f"), v).alias("entry"), named.alias("name"), "content"))
    own = F.substring("entry", 2, 20).cast("long")
    moved = atoms.filter((own % 11 != 5) & ((own % 7 != 3) | (F.col("pos") < 20))).withColumn("x", F.col("x") + 3).withColumn("z", F.col("z") - 4)
    report = A.compare(atoms, moved)
    counts = [F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("n_residue", "n_atom")]
    return report.select("entry", "error", *counts, *(F.round(c, 6).alias(c) for c in ("backbone_rmsd", "all_rmsd")))


@query("SELECT 'm' || c_custkey || '/' || repeat('long', CAST(c_custkey % 40 AS INT)) AS name, strlen(c_name) AS n_bytes, sha256(c_name) AS digest FROM customer")
def k03_archive(spark, sf_dir):
    """One archive whose members tasks write at their own places, opened again."""
    path = local_path(_scratch(spark, "archive")) + ".tar"
    name = F.concat(F.lit("m"), F.col("c_custkey"), F.lit("/"), F.expr("repeat('long', int(c_custkey % 40))"))
    S.write_archive(_table(spark, sf_dir, "customer").select(name.alias("name"), _bytes(F.col("c_name")).alias("content")), path)
    return S.entries(spark, "file://" + path).select("name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


@query("SELECT doc_id, source || CASE WHEN doc_id % 3 > 1 THEN lang ELSE '' END || CASE WHEN doc_id % 4 > 1 THEN '_' || (doc_id % 2) ELSE '' END || '.fcz' AS name FROM documents")
def k10_output_name(spark, sf_dir):
    k = F.col("doc_id")
    return _table(spark, sf_dir, "documents").select("doc_id", S.output_name(F.col("source"), F.col("lang"), k % 3, k % 2, k % 4).alias("name"))


@query(_CHAINS + " SELECT vec_id, 'c' || vec_id AS title, CAST(97 + 80 + strlen('c' || vec_id) + 9 * n_residue + n_side AS BIGINT) AS size, CAST(n_atom AS BIGINT) AS atom_lines, CAST(n_residue AS BIGINT) AS n_phi, sequence, CAST(n_residue - 1 AS BIGINT) AS measured FROM c")
def x02_api(spark, sf_dir):
    """The calls for structures in memory, entries decoded together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in E.together(frames):
            texts = [bytes(c).decode() for c in f["content"]]
            blobs = [api.compress(n.removesuffix(".pdb"), text) for n, text in zip(f["name"], texts, strict=True)]
            rows = []
            for n, text, blob, (title, back), stored in zip(f["name"], texts, blobs, api.decompress_many(blobs), api.get_data_many(blobs), strict=True):
                rows.append((int(n[1:-4]), title, len(blob), back.count("\nATOM"), len(stored["phi"]), stored["residues"], len(api.get_data(text)["phi"])))
            yield pd.DataFrame(rows, columns=["vec_id", "title", "size", "atom_lines", "n_phi", "sequence", "measured"])

    return _chain_files(spark, sf_dir).mapInPandas(run, "vec_id long, title string, size long, atom_lines long, n_phi long, sequence string, measured long")


@query("SELECT 'd' || doc_id AS name, strlen(coalesce(text, '')) AS size FROM documents")
def x01_each_entry(spark, sf_dir):
    """A function of name and bytes over every entry."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), _bytes(F.coalesce("text", F.lit(""))).alias("content"))
    return A.each_entry(docs, lambda name, content: (len(content),), "size long")


@query("SELECT vec_id, pos % 7 AS kind, CAST(v[pos + 1] AS DOUBLE) AS torsion FROM (SELECT vec_id, embedding AS v, unnest(range(len(embedding))) AS pos FROM embeddings) WHERE pos // 7 = 2")
def a15_torsion_of_kind(spark, sf_dir):
    """The third torsion of each kind of residue, in order of the chain."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "t"))
    lists = rows.groupBy("vec_id", (F.col("pos") % 7).cast("long").alias("kind")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("t").cast("double").alias("t")))).alias("held"))
    return lists.select("vec_id", "kind", F.get("held", F.lit(2))["t"].alias("torsion")).filter("torsion is not null")


# ---------------------------------------------------------------- dumps and audits


@query(_TORSION + f", f AS (SELECT vec_id, pos, {_fixed_sql('torsion', 3)} AS t FROM tor) SELECT vec_id, string_agg(t, chr(10) ORDER BY pos) || chr(10) AS dump FROM f GROUP BY vec_id")
def k14_torsion_dump(spark, sf_dir):
    """Torsions as text, a line each."""
    rows = C.torsions(_points(spark, sf_dir), ["vec_id"], ["pos"]).select("vec_id", "pos", T.fixed_decimals(F.col("torsion"), 3).alias("t"))
    return P.joined(rows, ["vec_id"], ["pos"], F.col("t"), "\n", "dump").withColumn("dump", F.concat("dump", F.lit("\n")))


_AUDIT = (
    _PTS
    + """, a AS (SELECT vec_id, pos, ['N', 'CA', 'C'][pos % 3 + 1] AS atom, CASE WHEN vec_id % 6 = 0 AND pos >= 12 THEN 'B' ELSE 'A' END AS chain, x * 10 AS x, y * 10 AS y, z * 10 AS z FROM p),
q AS (SELECT *, lag(atom) OVER w AS pa, lag(chain) OVER w AS pc, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, z - lag(z) OVER w AS az, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS byy, lead(z) OVER w - z AS bz FROM a WINDOW w AS (PARTITION BY vec_id ORDER BY pos))
SELECT vec_id, CAST(pos AS BIGINT) AS pos, atom, chain, CASE WHEN pc = chain THEN pa || '_' || atom END AS bond_name,
CASE WHEN pc = chain AND bx IS NOT NULL THEN round(degrees(acos(greatest(-1, least(1, -(ax * bx + ay * byy + az * bz) / sqrt((ax * ax + ay * ay + az * az) * (bx * bx + byy * byy + bz * bz)))))), 5) END AS bond_angle,
CASE WHEN pc = chain THEN round(sqrt(ax * ax + ay * ay + az * az), 5) END AS bond_length FROM q"""
)


@query(_AUDIT)
def k15_bond_audit(spark, sf_dir):
    out = C.bond_audit(_atom_rows(spark, sf_dir).select("vec_id", "pos", "atom", "chain", "x", "y", "z"), ["vec_id"], ["pos"])
    return out.select("vec_id", "pos", "atom", "chain", "bond_name", F.round("bond_angle", 5).alias("bond_angle"), F.round("bond_length", 5).alias("bond_length"))


@query(
    "WITH f AS (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, '#MIN:' || "
    + _fixed_sql("lo", 4) + " || chr(10) || '#MAX:' || " + _fixed_sql("hi", 4) + " || chr(10) || '#N_BIN:255' || chr(10) || '#DISC_F:' || " + _fixed_sql("(255 / (hi - lo))", 6) + " || chr(10) || '#CONT_F:' || " + _fixed_sql("((hi - lo) / 255)", 6) + " || chr(10) AS header FROM f"
)
def k21_quantizer_header(spark, sf_dir):
    fits = Q.fit(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 255)
    return fits.select("l_suppkey", Q.header(*(F.col(c) for c in ("lo", "hi", "n_bin", "disc_f", "cont_f"))).alias("header"))


@query(_BINS + "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, bin, round(lo, 2) AS lo, round(lo + bin * cont_f, 4) AS restored, round(v - (lo + bin * cont_f), 4) + 0.0 AS diff FROM q")
def k22_quantizer_audit(spark, sf_dir):
    """Each value's bin, what it restores and what is lost."""
    out = Q.audit(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 255)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "bin", F.round("lo", 2).alias("lo"), F.round("restored", 4).alias("restored"), (F.round("diff", 4) + 0.0).alias("diff"))


# ---------------------------------------------------------------- small readers, names and fields


@query(_PTS + """, m AS (SELECT *, unnest([1, 3]) AS model FROM p) SELECT 'v' || vec_id || '.cif' AS name, CAST(model AS INTEGER) AS model, CAST(pos + CASE model WHEN 3 THEN count(*) OVER (PARTITION BY vec_id, model) ELSE 0 END AS BIGINT) AS pos, ['N', 'CA', 'C'][pos % 3 + 1] AS atom,
CASE model WHEN 1 THEN CAST(""" + _fixed_sql("x * 10", 3) + " AS DOUBLE) ELSE 1.5 END AS x, CAST(" + _fixed_sql("y * 10", 3) + " AS DOUBLE) AS y FROM m")
def s04_components(spark, sf_dir):
    """Chemical components with coordinates of their own and ideal ones; numbers with uncertainties."""
    rows = _atom_rows(spark, sf_dir)
    x, y, z = (T.fixed_decimals(F.col(k), 3) for k in "xyz")
    line = F.concat_ws(" ", F.lit("GLY"), "atom", x, y, z, F.lit("1.5(3)"), y, z)
    text = P.joined(rows, ["name"], ["pos"], line, "\n", "text")
    tags = ("comp_id", "atom_id", "x", "y", "z", "pdbx_model_Cartn_x_ideal", "pdbx_model_Cartn_y_ideal", "pdbx_model_Cartn_z_ideal")
    head = "data_GLY\nloop_\n" + "".join(f"_chem_comp_atom.{t}\n" for t in tags)
    return S.atoms(text.select(F.concat("name", F.lit(".cif")).alias("name"), _bytes(F.concat(F.lit(head), "text", F.lit("\n"))).alias("content"))).select("name", "model", "pos", "atom", "x", "y")


@query("SELECT 'v' || vec_id || '.pdb' AS name, CASE WHEN vec_id % 6 = 0 THEN 'more than one chain' END AS error FROM embeddings")
def s10_atom_lines_of_one_chain(spark, sf_dir):
    """The short way in takes one chain alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            errors: list[str | None] = []
            for c in f["content"]:
                try:
                    api.compress("x", bytes(c).decode())
                    errors.append(None)
                except api.Error as e:
                    errors.append(str(e))
            yield pd.DataFrame({"name": f["name"], "error": errors})

    return _pdb_files(spark, sf_dir).mapInPandas(run, "name string, error string")


@query("SELECT doc_id, regexp_matches(source || '/' || doc_id || ['.pdb', '.tar', '.cif.gz', '', '.fcz'][doc_id % 5 + 1], '\\.(pdb|pdb\\.gz|cif|cif\\.gz|fcz)$') AS is_file FROM documents")
def s12_lines_of_a_list(spark, sf_dir):
    """Which lines of a file list are files of their own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            files = set(S.listed_paths(f["path"].tolist())[0])
            yield pd.DataFrame({"doc_id": f["doc_id"], "is_file": f["path"].isin(files)})

    ending = F.element_at(F.array(*map(F.lit, (".pdb", ".tar", ".cif.gz", "", ".fcz"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", ending).alias("path")).mapInPandas(run, "doc_id long, is_file boolean")


@query(_PTS + " SELECT vec_id, list(x ORDER BY pos) AS xs, list(y ORDER BY pos) AS ys FROM p GROUP BY vec_id")
def p05_coordinates(spark, sf_dir):
    """The coordinates alone."""
    p = C.points_of(F.col("embedding"))
    held = _table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    return held.select("vec_id", F.transform("p", lambda c: c["x"].cast("double")).alias("xs"), F.transform("p", lambda c: c["y"].cast("double")).alias("ys"))


@query("SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS whole FROM embeddings")
def u02_joined_segments(spark, sf_dir):
    """Arrays cut with an overlap of three and put together again."""
    v = F.col("embedding").cast("array<double>")
    starts = F.sequence(F.lit(0), F.size(v) - 4, F.lit(13))
    parts = F.transform(starts, lambda i: F.slice(v, i + 1, F.lit(16)))
    return _table(spark, sf_dir, "embeddings").select("vec_id", M.joined_segments(parts, 3).alias("whole"))


_NAMES_SQL = ", ".join(f"({k}, '{n}')" for k, n in enumerate(R.alphabetical()))


@query(f"SELECT p_partkey, a.name FROM part JOIN (VALUES {_NAMES_SQL}) a(i, name) ON a.i = p_partkey % {len(R.alphabetical())}")
def f18_alphabetical_residues(spark, sf_dir):
    names = F.array(*map(F.lit, R.alphabetical()))
    return _table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % len(R.alphabetical())).cast("int")).alias("name"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS number, reverse(CAST(o_custkey AS VARCHAR)) AS reversed FROM orders")
def f22_number_text(spark, sf_dir):
    text = F.col("o_custkey").cast("string")
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("number"), F.reverse(text).alias("reversed"))


@query("SELECT doc_id, trim(chr(9) || ' ' || text || ' ' || chr(9), ' ' || chr(9)) AS stripped FROM documents")
def f23_strip_blanks(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.strip_blanks(F.concat(F.lit("\t "), "text", F.lit(" \t"))).alias("stripped"))


@query("SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM conversations")
def f28_words(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("words"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 99999 AS BIGINT) AS decimal, 100000 + o_orderkey % 26 AS upper, 100000 + 26 * 36 * 36 * 36 * 36 + o_orderkey % 10 AS lower, o_orderstatus AS status FROM orders""")
def f29_record_fields(spark, sf_dir):
    """numbers in columns, decimal or going on in base 36, and trimmed text."""
    k = F.col("o_orderkey")
    top, low = F.concat(F.lit("A000"), F.conv((k % 26).cast("string"), 10, 36)), F.concat(F.lit("a000"), (k % 10).cast("string"))
    line = F.concat(F.lit("HETATM"), F.lpad((k % 99999).cast("string"), 5, " "), top, low, F.lit("  "), "o_orderstatus", F.lit("  "))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    numbers = {n: T.hybrid_number(T.cut(F.col("line"), a, a + 4), 5) for n, a in (("decimal", 7), ("upper", 12), ("lower", 17))}
    return rows.select("o_orderkey", *(v.alias(n) for n, v in numbers.items()), T.cut(F.col("line"), 22, 26).alias("status"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def f30_dates(spark, sf_dir):
    """dates of records, with a month's name and a year of two digits."""
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.iso_date(F.upper(F.date_format("o_orderdate", "dd-MMM-yy"))).alias("iso"))


@query("SELECT * FROM (VALUES ('N', 'CA', 1.4581::DOUBLE), ('CA', 'C', 1.5281), ('C', 'N', 1.3311), ('N', 'CA of PRO', 1.353)) t(a, b, length)")
def f34_bond_lengths(spark, sf_dir):
    rows = [("N", "CA", R.N_CA), ("CA", "C", R.CA_C), ("C", "N", R.C_N), ("N", "CA of PRO", R.PRO_N_CA)]
    return spark.createDataFrame(rows, "a string, b string, length double")


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey * 7919 % 10007, s_suppkey) - 1 AS place, s_suppkey * 7919 % 10007 AS key FROM supplier""")
def o03_order_of_given_keys(spark, sf_dir):
    """A database whose entries bring keys is laid out in their order; each entry is a byte long, so offsets are places."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), F.lit(bytearray(b"x")).alias("content"), (F.col("s_suppkey") * 7919 % 10007).alias("k"))
    return K.layout(rows, key="k").select(F.col("name").cast("long").alias("s_suppkey"), F.col("offset").alias("place"), "key")


_TARGETS = [("a/b.pdb", None, "fcz", False, False, False, "a/b.fcz"), ("a/b/", None, "fcz", True, False, False, "a/b_fcz/"), ("d", None, "fcz", True, True, False, "d.fcz.tar"), ("d", "e", "fcz", True, False, False, "e"), ("d", None, "fcz", True, False, True, "d_db")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t[-1]}')" for k, t in enumerate(_TARGETS)) + ") t(place, target)")
def k09_output_targets(spark, sf_dir):
    return spark.createDataFrame([(k, S.output_target(*t[:-1])) for k, t in enumerate(_TARGETS)], Y.StructType([Y.StructField("place", Y.IntegerType()), Y.StructField("target", Y.StringType())]))


@query("SELECT r_name AS name, 'exists already' AS error FROM region")
def k11_overwrite_guard(spark, sf_dir):
    """A file for each row; one that is there already stays."""
    folder = local_path(_scratch(spark, "files"))
    rows = _table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), _bytes(F.col("r_name")).alias("content"))
    write_files(rows, folder)
    return write_files(rows, folder)
