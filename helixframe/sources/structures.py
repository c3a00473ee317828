"""Scans of structure texts into atom rows, and text and archive sinks."""

from __future__ import annotations

import gzip
import io
import itertools
import json
import os
import re
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import base_name, cut, hybrid_number, without_extension
from ..operators.entry_codec import ATOM_FIELDS
from ..operators.lookup import keyed_offsets
from . import archive_format
from .shared import local_path, materialise, write_parts

#: entry tells inputs apart, whatever their names.
ATOM_SCHEMA = "entry string, name string, model int, pos long, atom_index long, atom string, altloc string, residue string, chain string, residue_index int, icode string, x double, y double, z double, occupancy double, temp_factor double, record string"
_COLUMNS = [c.split()[0] for c in ATOM_SCHEMA.split(", ")]


#: Bytes of content, and atoms, that a batch of rows holds before it is handed on.
BATCH_BYTES, BATCH_ATOMS = 4 << 20, 20_000


def in_pieces(frames: Iterator[pd.DataFrame], content: str = "content") -> Iterator[pd.DataFrame]:
    """Frames cut after about BATCH_BYTES of content each."""
    for f in frames:
        sizes = f[content].map(lambda c: 0 if c is None else len(c)).cumsum().to_numpy()
        cuts = [0, *((sizes[:-1] // BATCH_BYTES != sizes[1:] // BATCH_BYTES).nonzero()[0] + 1), len(f)]
        for a, b in itertools.pairwise(cuts):
            if a < b:
                yield f.iloc[a:b]


def entries(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """path, entry, name, content of files; gzipped ones are opened, archives give an entry for each regular member.

    entry is the path, with the member's name and place for a member of an archive: it tells
    files of one name apart. A file that cannot be opened is an entry without content. An
    archive on mounted storage is read by ranges; elsewhere it is one row of Spark's
    binaryFile, so of 2 GB at most.
    """
    if isinstance(path, str) and archive_format.ARCHIVE.search(path) and ("://" not in path or path.startswith("file:")) and os.path.isfile(local_path(path)):
        return archive_format.load(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    return opened(files)


def opened(files: DataFrame) -> DataFrame:
    """As entries, of rows (path, content)."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for k, (name, data, inner) in enumerate(members(path, content)):
                yield path, f"{path}#{k}:{name}" if inner else path, name, data
        except (OSError, EOFError, tarfile.TarError, zlib.error):
            yield path, path, re.split(r"[/\\]", path)[-1], None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                for row in rows(path, bytes(content)):
                    held.append(row)
                    size += len(row[3] or b"")
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(held, columns=["path", "entry", "name", "content"])
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "entry", "name", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, entry string, name string, content binary")


def members(path: str, content: bytes) -> Iterator[tuple[str, bytes, bool]]:
    """(name, bytes, whether it is a member) of a file, or of each regular member of an archive; members without a name go."""
    file = re.split(r"[/\\]", path)[-1]
    if re.search(r"\.(tar|tar\.gz|tgz)$", file):
        with tarfile.open(fileobj=io.BytesIO(content)) as archive:
            for m in archive:
                if m.isreg() and m.name:
                    yield m.name, archive.extractfile(m).read(), True
    elif file.endswith(".gz"):
        yield file[:-3], gzip.decompress(content), False
    else:
        yield file, content, False


#: Endings that make a line of a file list a file of its own; all other lines are inputs, such as folders or archives.
FILE_ENDINGS = (".pdb", ".pdb.gz", ".cif", ".cif.gz", ".fcz")
#: Paths of a list that are given to one scan at a time.
LISTED = 10_000


def listed_paths(lines: list[str]) -> tuple[list[str], list[str]]:
    """(files, other inputs) of a list's lines."""
    lines = [x.strip() for x in lines if x.strip()]
    return [x for x in lines if x.endswith(FILE_ENDINGS)], [x for x in lines if not x.endswith(FILE_ENDINGS)]


def file_list(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """entries of the inputs that a text file lists, a path in each line. The paths alone pass the driver, which has to plan the scan."""
    files, others = listed_paths([r["value"] for r in spark.read.text(path).toLocalIterator()])
    if not files + others:
        return spark.createDataFrame([], "path string, entry string, name string, content binary")
    scans = [entries(spark, files[k : k + LISTED]) for k in range(0, len(files), LISTED)] + [entries(spark, x, recursive) for x in others]
    out = scans[0]
    for scan in scans[1:]:
        out = out.unionByName(scan)
    return out


def sniff(content: Column) -> Column:
    """mmjson, cif, entry or pdb, by how the content begins; blank and # lines are skipped."""
    # Possessive, so that neither a long run of such lines nor its lack takes the stack.
    head = F.regexp_extract(F.decode(content, "ISO-8859-1"), r"^(?:\s++|#[^\n]*+\n)*+(.{0,5})", 1)
    return F.when(F.hex(F.substring(content, 1, 4)) == "46434D50", "entry").when(head.startswith("{"), "mmjson").when(F.lower(head).startswith("data_"), "cif").otherwise("pdb")


def format_of(name: Column) -> Column:
    """The format that a file name's ending stands for."""
    stem = F.lower(F.regexp_replace(name, r"\.gz$", ""))
    return F.when(stem.rlike(r"\.(cif|mmcif)$"), "cif").when(stem.endswith(".json"), "mmjson").when(stem.endswith(".fcz"), "entry").otherwise("pdb")


def _keyed(texts: DataFrame) -> DataFrame:
    """texts with the column entry; where they have none, a text's name is what tells it apart."""
    return texts if "entry" in texts.columns else texts.withColumn("entry", F.col("name"))


def _pdb_fields(line: Column) -> dict[str, Column]:
    """Columns of an ATOM or HETATM record."""
    return {
        "atom_index": F.coalesce(hybrid_number(cut(line, 7, 11), 5), F.lit(0)),
        "atom": cut(line, 13, 16),
        "altloc": F.nullif(cut(line, 17, 17), F.lit("")),
        "residue": cut(line, 18, 20),
        "chain": cut(line, 21, 22),
        "residue_index": hybrid_number(cut(line, 23, 26), 4).cast("int"),
        "icode": F.nullif(cut(line, 27, 27), F.lit("")),
        **{n: cut(line, a, b).try_cast("double") for n, a, b in (("x", 31, 38), ("y", 39, 46), ("z", 47, 54))},
        "occupancy": F.coalesce(cut(line, 55, 60).try_cast("double"), F.lit(1.0)),
        "temp_factor": F.coalesce(cut(line, 61, 66).try_cast("double"), F.lit(0.0)),
    }


def pdb_atoms(texts: DataFrame, hetero: bool = True) -> DataFrame:
    """Atom rows of PDB texts (name, content and, where names repeat, entry), by column expressions alone.

    Reading stops at END. Models are counted by their records. Atoms of a residue that
    comes up again within an unbroken chain are put to that residue, as pos has it.
    """
    # Byte for byte: what is read is ASCII, and bytes that are no UTF-8 must not end the job.
    text = F.decode(F.col("content"), "ISO-8859-1")
    lines = _keyed(texts).select("entry", "name", F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    file = W.partitionBy("entry").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    record = F.rpad(F.substring("line", 1, 6), 6, " ")
    wanted = ("ATOM  ", "HETATM") if hetero else ("ATOM  ",)
    rows = lines.withColumn("record", record).filter(F.col("record").isin("ATOM  ", "HETATM", "MODEL ", "END   ", "TER   "))
    rows = rows.withColumn("ended", F.max((F.col("record") == "END   ").cast("int")).over(file)).filter("ended = 0")
    rows = rows.withColumn("model", F.greatest(F.sum((F.col("record") == "MODEL ").cast("int")).over(file), F.lit(1)).cast("int"))
    line = F.col("line")
    rows = rows.filter(F.col("record").isin(*wanted)).select(
        "entry", "name", "model", "line_no",
        *(c.alias(n) for n, c in _pdb_fields(line).items()),
        F.trim("record").alias("record"),
    )
    return _regrouped(rows)


def _regrouped(rows: DataFrame) -> DataFrame:
    """pos: atoms in order, those of a residue together within a run of one chain."""
    order = W.partitionBy("entry", "model").orderBy("line_no")
    rows = rows.withColumn("_new", (~F.col("chain").eqNullSafe(F.lag("chain").over(order))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min("line_no").over(W.partitionBy("entry", "model", "_run", "residue_index", "icode", "residue"))
    rows = rows.withColumn("_first", first)
    pos = F.row_number().over(W.partitionBy("entry").orderBy("model", "_run", "_first", "line_no")) - 1
    return rows.withColumn("pos", pos.cast("long")).select(*_COLUMNS)


_CIF_WORD = re.compile(r"""'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|"((?:[^"\n]|"(?=\S))*)"(?=\s|$)|^;(.*?)\n;|(\#[^\n]*)|(\S+)""", re.S | re.M)


def _cif_words(text: str) -> Iterator[tuple[str, bool]]:
    """(word, quoted) of a CIF text; comments go."""
    for m in _CIF_WORD.finditer(text):
        single, double, block, comment, bare = m.groups()
        if comment is None:
            yield (bare, False) if bare is not None else (next(x for x in (single, double, block) if x is not None), True)


def cif_items(text: str) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Single items and columns of loops of the first block."""
    items: dict[str, str] = {}
    columns: dict[str, list[str]] = {}
    tags: list[str] = []
    state, tag, blocks, k = "", "", 0, 0
    for word, quoted in _cif_words(text):
        low = word.lower()
        if not quoted and low.startswith("data_"):
            blocks += 1
            state = ""
            if blocks > 1:
                break
        elif not quoted and low == "loop_":
            state, tags, k = "tags", [], 0
        elif not quoted and word.startswith("_"):
            if state == "tags":
                tags.append(low)
                columns[low] = []
            else:
                state, tag = "item", low
        elif state == "item":
            items[tag], state = word, ""
        elif state in ("tags", "values") and tags:
            state = "values"
            columns[tags[k % len(tags)]].append(word)
            k += 1
    return items, columns


def _number(text: str | float | None, default: float) -> float:
    """A number, a standard uncertainty in brackets aside."""
    if isinstance(text, (int, float)):
        return float(text)
    try:
        return float(re.sub(r"\(\d+\)$", "", text))
    except (TypeError, ValueError):
        return default


def _category(columns: dict[str, list], prefix: str = "_atom_site.") -> Iterator[tuple]:
    """Atom rows, without name and pos, of the columns of an atom table; the author's names go before others."""
    n = max((len(v) for k, v in columns.items() if k.startswith(prefix)), default=0)

    def column(*names: str) -> list:
        for x in names:
            if (v := columns.get(prefix + x)) is not None and len(v) == n:
                return v
        return [None] * n

    def plain(v) -> str | None:
        return None if v in (None, "?", ".") else str(v)

    parts = [column(*x) for x in (
        ("pdbx_pdb_model_num",), ("id",), ("auth_atom_id", "label_atom_id"), ("label_alt_id",), ("auth_comp_id", "label_comp_id"), ("auth_asym_id", "label_asym_id"),
        ("auth_seq_id", "label_seq_id"), ("pdbx_pdb_ins_code",), ("cartn_x",), ("cartn_y",), ("cartn_z",), ("occupancy",), ("b_iso_or_equiv",), ("group_pdb",),
    )]
    for model, i, atom, alt, residue, chain, number, icode, x, y, z, occupancy, temp, group in zip(*parts, strict=True):
        yield (
            int(_number(plain(model), 1)), int(_number(plain(i), 0)), plain(atom), plain(alt), plain(residue), plain(chain), int(_number(plain(number), 0)), plain(icode),
            _number(x, float("nan")), _number(y, float("nan")), _number(z, float("nan")), _number(occupancy, 1.0), _number(temp, 50.0), plain(group) or "ATOM",
        )


def _component(columns: dict[str, list]) -> Iterator[tuple]:
    """Atom rows of a chemical component's table: a model for each set of coordinates that it has."""
    at = "_chem_comp_atom."
    n = len(columns.get(at + "atom_id", ()))
    sets = (("x", "y", "z"), *(tuple(f"{p}cartn_{k}{q}" for k in "xyz") for p, q in (("model_", ""), ("pdbx_model_", "_ideal"))))
    for model, names in enumerate(sets, 1):
        held = [columns.get(at + c, []) for c in names]
        if n and all(len(c) == n for c in held):
            residue = columns.get(at + "comp_id", ["UNL"] * n)
            for k, (atom, *xyz) in enumerate(zip(columns[at + "atom_id"], *held, strict=True)):
                yield (model, k + 1, atom, None, residue[k], "", 1, None, *(_number(v, float("nan")) for v in xyz), 1.0, 0.0, "HETATM")


def _parsed(text: str, kind: str) -> tuple[dict[str, list], dict[str, str]]:
    """Columns and single items of a CIF or mmJSON text. Text that breaks the syntax raises ValueError."""
    if kind == "cif":
        items, columns = cif_items(text)
        return columns, items
    held = json.loads(text)
    block = next(iter(held.values()), {}) if isinstance(held, dict) else {}
    if not isinstance(block, dict):
        raise ValueError("no data block")
    columns = {f"_{category}.{k}".lower(): v for category, own in block.items() if isinstance(own, dict) for k, v in own.items() if isinstance(v, list)}
    return columns, {k: str(v[0]) for k, v in columns.items() if len(v) == 1 and v[0] is not None}


def parsed_atoms(texts: DataFrame, kind: str) -> DataFrame:
    """Atom rows of CIF or mmJSON texts, whose syntax column expressions cannot follow. Broken ones give none."""
    schema = ATOM_SCHEMA.replace("pos long", "line_no long")
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for e, n, c in zip(f["entry"], f["name"], f["content"], strict=True):
                try:
                    found = _parsed(bytes(c).decode("utf-8", "replace"), kind)[0]
                    table = _category if any(k.startswith("_atom_site.") for k in found) else _component
                    rows += [(e, n, r[0], k, *r[1:]) for k, r in enumerate(table(found))]
                except (ValueError, TypeError, OverflowError):
                    pass
                if len(rows) > BATCH_ATOMS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return _regrouped(_keyed(texts).select("entry", "name", "content").mapInPandas(run, schema))


def atoms(texts: DataFrame) -> DataFrame:
    """Atom rows of texts of any format, told by their content; columns name, content and, where names repeat, entry.

    Texts that are null, empty, broken or without atoms give no rows.
    """
    held = _keyed(texts).filter("content is not null").withColumn("_kind", sniff(F.col("content")))
    out = pdb_atoms(held.filter("_kind = 'pdb'"))
    for kind in ("cif", "mmjson"):
        out = out.unionByName(parsed_atoms(held.filter(F.col("_kind") == kind), kind))
    return out


def record_arrays(texts: DataFrame) -> DataFrame:
    """entry, name, title, kind, atoms and content of texts (entry, name, title, content), a row each.

    atoms: a PDB text's records in order, those that end a text or begin a model among
    them, as structs of entry_codec.ATOM_FIELDS. Texts that column expressions cannot
    follow keep their content instead.
    """
    kind = sniff(F.col("content"))
    lines = F.split(F.decode(F.col("content"), "ISO-8859-1"), r"\r?\n")

    def record(line: Column) -> Column:
        return F.rpad(F.substring(line, 1, 6), 6, " ")

    def fields(line: Column) -> Column:
        found = _pdb_fields(line) | {"record": F.trim(record(line)), "model": F.lit(None).cast("int")}
        return F.struct(*(found[n].alias(n) for n in ATOM_FIELDS))

    held = texts.select("entry", "name", "title", "content", kind.alias("kind"))
    atoms = F.transform(F.filter(lines, lambda x: record(x).isin("ATOM  ", "HETATM", "MODEL ", "END   ")), fields)
    return held.select("entry", "name", "title", "kind", F.when(F.col("kind") == "pdb", atoms).alias("atoms"), F.when(F.col("kind").isin("cif", "mmjson"), F.col("content")).alias("content"))


def parsed_records(content: bytes, kind: str) -> list[tuple]:
    """Tuples of entry_codec.ATOM_FIELDS of a CIF or mmJSON text; a broken one has none."""
    try:
        found = _parsed(content.decode("utf-8", "replace"), kind)[0]
        table = _category if any(k.startswith("_atom_site.") for k in found) else _component
        return [(group, model, chain, residue, number, icode, atom, i, x, y, z, temp) for model, i, atom, _, residue, chain, number, icode, x, y, z, _, temp, group in table(found)]
    except (ValueError, TypeError, OverflowError):
        return []


def titles(texts: DataFrame, contents: bool = False) -> DataFrame:
    """entry, name and title, and with contents content: the entry's id that its text has, else its title, else its file's name without ending.

    Of PDB texts the id is that of the HEADER record and the title what its TITLE records say.
    """
    held = _keyed(texts).select("entry", "name", F.coalesce("content", F.lit(bytearray())).alias("content")).withColumn("kind", sniff(F.col("content")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for kind, c in zip(f["kind"], f["content"], strict=True):
                text = bytes(c).decode("utf-8", "replace")
                ident = name = None
                try:
                    if kind == "pdb":
                        head = text[: text.find("\nATOM")] if "\nATOM" in text else text
                        lines = head.splitlines()
                        ident = next((x[62:66].strip() for x in lines if x.startswith("HEADER")), None)
                        name = "".join(x[10:80].rstrip() for x in lines if x.startswith("TITLE ")).strip()
                    elif kind != "entry":
                        items = _parsed(text, kind)[1]
                        ident, name = items.get("_entry.id"), items.get("_struct.title")
                except (ValueError, TypeError):
                    pass
                found.append((ident, name))
            out = pd.DataFrame({"entry": f["entry"], "name": f["name"], "ident": [x[0] for x in found], "struct": [x[1] for x in found]})
            yield out.assign(content=f["content"]) if contents else out

    kept = ["content"] if contents else []
    rows = held.mapInPandas(run, "entry string, name string, ident string, struct string" + ", content binary" * contents)
    return rows.select("entry", "name", *kept, title(F.col("ident"), F.col("struct"), F.col("name")).alias("title"))


def single_chain(rows: DataFrame) -> DataFrame:
    """entry, name, chains and n_atom of texts; those with several chains or no atom have an error, null otherwise."""
    out = rows.filter("record = 'ATOM'").groupBy("entry", "name").agg(F.count_distinct("chain").alias("chains"), F.count(F.lit(1)).alias("n_atom"))
    return out.withColumn("error", F.when(F.col("chains") > 1, "more than one chain").when(F.col("n_atom") == 0, "no atoms"))


def title(items: Column, struct_title: Column, file: Column) -> Column:
    """The entry's id, else its title, else its file's name; the name alone where it is the file's."""
    found = F.coalesce(F.nullif(items, F.lit("")), F.nullif(struct_title, F.lit("")), file)
    return F.when(found == base_name(file), without_extension(base_name(file))).otherwise(found)


def output_name(base: Column, chain: Column, chains: Column, fragment: Column, fragments: Column, suffix: str = ".fcz") -> Column:
    """The base, the chain where there are several, the fragment's number where there are several, and a suffix."""
    return F.concat(base, F.when(chains > 1, chain).otherwise(""), F.when(fragments > 1, F.concat(F.lit("_"), fragment.cast("string"))).otherwise(""), F.lit(suffix))


def write_archive(rows: DataFrame, path: str, name: str = "name", content: str = "content", overwrite: bool = False) -> int:
    """Writes one archive of rows, in order of name, to a path on storage that all executors mount; returns its size.

    A member's place follows from the sizes of those before it, so each task writes
    its own members and none holds the archive.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            blocks = []
            for k, c in zip(f["name"], f["content"], strict=True):
                info = tarfile.TarInfo(k)
                info.size = len(c)
                blocks.append(info.tobuf(tarfile.GNU_FORMAT) + bytes(c) + b"\0" * (-len(c) % tarfile.BLOCKSIZE))
            yield pd.DataFrame({"name": f["name"], "content": blocks})

    members = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).filter("content is not null")
    laid = materialise(keyed_offsets(members.mapInPandas(run, "name string, content binary"), ["name"], F.octet_length("content")), "archive")
    size = (laid.agg(F.sum("length")).first()[0] or 0) + 2 * tarfile.BLOCKSIZE  # two blocks of zeros are its end
    write_parts(laid, path, size, overwrite)
    return size


def torsion_text(spark: SparkSession, path: str) -> DataFrame:
    """path and angle, a number in each line of text files; lines that are none go."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").try_cast("double").alias("angle"))
    return rows.filter("angle is not null")


def output_target(given: str, out: str | None, suffix: str, is_folder: bool, archive: bool = False, database: bool = False) -> str:
    """Where results go: the path asked for, else one named after the input and the kind of output."""
    if out:
        return out
    base = given.rstrip("/")
    if database:
        return f"{base}_db"
    if archive:
        return f"{base}.{suffix}.tar"
    return f"{base}_{suffix}/" if is_folder else f"{re.sub(r'[.][^./]*$', '', base)}.{suffix}"
