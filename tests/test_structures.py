"""Structure scans, the entry codec and whole plans, against golden values."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import entry_codec as E
from helixframe.plans import structures as P
from helixframe.sources import keyed_db
from helixframe.sources import structures as S

DATA = Path(__file__).parent / "data"


@pytest.fixture(scope="module")
def texts(spark):
    return S.entries(spark, str(DATA)).filter("name like '%.pdb'").select("name", "content").cache()


def test_scan_counts(spark, texts):
    got = {r["name"]: (r["n"], r["c"]) for r in S.atoms(texts).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("chain").alias("c")).collect()}
    assert got == {"test.pdb": (2208, 1), "test_af.pdb": (243, 1), "multichain.pdb": (4678, 2)}


def test_fragments_and_names(spark, texts):
    got = {r["name"]: r["error"] for r in P.compress_texts(texts).collect()}
    assert got == dict.fromkeys(["multichainA.fcz", "multichainB_0.fcz", "multichainB_1.fcz", "test.fcz", "test_af.fcz"])
    left = {r["name"] for r in P.compress_texts(texts, skip_discontinuous=True).collect()}
    assert left == {"multichainA.fcz", "test.fcz", "test_af.fcz"}


def test_round_trip_distance(spark, texts):
    one = texts.filter("name = 'test.pdb'")
    entries = P.compress_texts(one).select("name", "blob")
    back = E.decompress(entries).withColumn("name", F.lit("x"))
    row = P.compare(S.atoms(one).withColumn("name", F.lit("x")), back, key="name").first()
    assert row["error"] is None and row["n_residue"] == 276 and row["n_atom"] == 2208
    assert abs(row["all_rmsd"] - 0.0826751) < 0.001


def test_unequal_structures_are_told(spark, texts):
    """No distance over a prefix, over entries of one name, or where a side is missing."""
    atoms = S.atoms(texts).cache()
    half = atoms.filter("name <> 'test_af.pdb' or pos < 100").filter("name <> 'test.pdb'")
    got = {r["entry"].rsplit("/", 1)[-1]: r for r in P.compare(atoms, half).collect()}
    assert got["test_af.pdb"]["error"] == "the numbers of atoms differ: 243 and 100" and got["test_af.pdb"]["all_rmsd"] is None
    assert got["test.pdb"]["error"] == "the second has no atoms"
    assert got["multichain.pdb"]["error"] is None and got["multichain.pdb"]["all_rmsd"] == 0
    same = atoms.withColumn("name", F.lit("x.pdb"))
    (row,) = P.compare(same, same, key="name").collect()
    assert row["error"] == "several structures of one name" and row["n_atom"] is None


def test_confidence_golden(spark, texts):
    entries = P.compress_texts(texts.filter("name = 'test_af.pdb'")).select("name", "blob")
    assert P.extract_plddt(entries, 1).first()["data"] == "5666777787777787777777776665"
    four = P.extract_plddt(entries, 4).first()["data"].split(",")
    assert four[:5] == ["56.93", "65.26", "67.18", "66.79", "74.17"] and four[-1] == "59.32" and len(four) == 28
    assert P.check_entries(entries).first()["outcome"] == "SUCCESS"
    assert P.extract_fasta(entries).first()["record"].startswith(">test_af.fcz\n")


def test_text_out_reads_back(spark, texts):
    entries = P.compress_texts(texts.filter("name = 'test_af.pdb'")).select("name", "blob")
    text = P.decompress_texts(entries, alternate=True)
    again = S.pdb_atoms(text.select("name", F.encode("text", "UTF-8").alias("content")))
    assert again.count() == 243
    assert "TER" in text.first()["text"]


def test_micro_fixtures():
    assert E.torsions(np.array([[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 1, 1]], float))[0] == pytest.approx(-90)
    assert E.bond_angles(np.array([[1, 0, 0], [0, 0, 0], [0, 1, 0]], float))[0] == pytest.approx(90)
    assert E.anchor_indices(276, 25).tolist() == [*range(0, 254, 23), 253, 275][:11] + [253, 275] or len(E.anchor_indices(276, 25)) == 13
    assert E.anchor_indices(28, 25).tolist() == [0, 14, 27]
    assert E.anchor_indices(77, 25).tolist() == [0, 19, 38, 57, 76]
    low, step, bins = E._fit(np.array([56.93, 67.20, 81.36]), 255)
    assert bins[1] == 107 and round(low + 107 * step, 3) == 67.181
    assert E._fit(np.array([5.0, 5, 5]), 255)[1:][0] == 0


def test_bad_entries():
    with pytest.raises(E.EntryError):
        E.parse(b"nothing")
    with pytest.raises(E.EntryError):
        E.parse(b"FCMP")
    with pytest.raises(E.EntryError):
        E.anchor_indices(5, 0)


CIF = """data_x
_entry.id X # comment
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.auth_atom_id
_atom_site.label_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM 1 "O5'" ALA A 1 1.0 2.5(3) ?
ATOM 2 CA 'A B' A 1 1 2 3
"""


def test_cif_and_json(spark):
    block = {"data_x": {"atom_site": {"id": [1, 2], "label_atom_id": ["N", "CA"], "auth_comp_id": ["GLY", "GLY"], "auth_asym_id": ["B", "B"], "auth_seq_id": [4, 4], "Cartn_x": [0, 1], "Cartn_y": [0, 1], "Cartn_z": [0, 1]}}}
    frame = spark.createDataFrame([("a.cif", CIF.encode()), ("b.json", json.dumps(block).encode())], "name string, content binary")
    rows = sorted(S.atoms(frame).select("name", "pos", "atom", "residue", "residue_index", "y", "temp_factor").collect())
    assert [(r["name"], r["atom"], r["residue"]) for r in rows] == [("a.cif", "O5'", "ALA"), ("a.cif", "CA", "A B"), ("b.json", "N", "GLY"), ("b.json", "CA", "GLY")]
    assert rows[0]["y"] == 2.5 and rows[0]["temp_factor"] == 50.0


def test_gzip_tar_and_archive(spark, tmp_path):
    raw = (DATA / "test_af.pdb").read_bytes()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.pdb.gz").write_bytes(gzip.compress(raw))
    with tarfile.open(tmp_path / "in" / "two.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("inner.pdb")
        info.size = len(raw)
        t.addfile(info, io.BytesIO(raw))
    got = S.entries(spark, str(tmp_path / "in"))
    assert sorted((r["name"], bytes(r["content"]) == raw) for r in got.collect()) == [("inner.pdb", True), ("one.pdb", True)]
    size = S.write_archive(got.select("name", "content"), str(tmp_path / "out.tar"))
    assert size == (tmp_path / "out.tar").stat().st_size
    with tarfile.open(tmp_path / "out.tar") as t:
        assert t.getnames() == ["inner.pdb", "one.pdb"] and t.extractfile("one.pdb").read() == raw
    with pytest.raises(FileExistsError):
        S.write_archive(got.select("name", "content"), str(tmp_path / "out.tar"))


def test_keyed_database(spark, tmp_path):
    frame = spark.createDataFrame([("b", b"22"), ("a", b"1"), ("c", b"333")], "name string, content binary")
    keyed_db.write(frame, str(tmp_path / "db"))
    assert [tuple(r) for r in keyed_db.read_index(spark, str(tmp_path / "db/index")).orderBy("key").collect()] == [(0, 0, 1), (1, 1, 2), (2, 3, 3)]
    assert keyed_db.read(spark, str(tmp_path / "db")).count() == 3
    asked = keyed_db.read(spark, str(tmp_path / "db"), ["c", "nobody", "a", "c"]).orderBy("ord").collect()
    assert [(r["ord"], r["name"], bytes(r["content"])) for r in asked] == [(0, "c", b"333"), (2, "a", b"1"), (3, "c", b"333")]
    with pytest.raises(KeyError):
        keyed_db.read(spark, str(tmp_path / "db"), ["nobody"], strict=True)
    native = tmp_path / "plain"
    native.write_bytes(b"122333")
    (tmp_path / "plain.index").write_text("0\t0\t1\n1\t1\t2\n2\t3\t3\n")
    (tmp_path / "plain.lookup").write_text("0\ta\t0\n1\tb\t0\n2\tc\t0\n")
    got = {r["name"]: bytes(r["content"]) for r in keyed_db.read_native(spark, str(native)).collect()}
    assert got == {"a": b"1", "b": b"22", "c": b"333"}


def test_streaming_ingest(spark, tmp_path):
    from helixframe.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "test_af.pdb").write_bytes((DATA / "test_af.pdb").read_bytes())
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["name"], r["error"]) for r in rows] == [("test_af.fcz", None)]


def test_api():
    from helixframe import api

    text = (DATA / "test_af.pdb").read_text()
    blob = api.compress("t" * 71, text)
    assert len(blob) == 698
    name, out = api.decompress(blob)
    assert name == "t" * 71 and out.count("ATOM  ") == 243 and out.startswith("TITLE     " + "t" * 70 + "\nTITLE    2 t\n")
    measured, stored = api.get_data(text), api.get_data(blob)
    assert len(measured["phi"]) == 27 and len(stored["phi"]) == 28 and measured["residues"] == stored["residues"]
    assert np.abs(np.array(measured["psi"]) - np.array(stored["psi"][:27])).max() < 0.1
    assert len(api.split_pdb_by_chain((DATA / "multichain.pdb").read_text())) == 2
    with pytest.raises(api.Error):
        api.compress("x", (DATA / "multichain.pdb").read_text())
    with pytest.raises(api.Error):
        api.compress("x", "nothing")


def test_component_and_small_readers(spark, tmp_path):
    text = "data_ALA\nloop_\n_chem_comp_atom.comp_id\n_chem_comp_atom.atom_id\n_chem_comp_atom.model_Cartn_x\n_chem_comp_atom.model_Cartn_y\n_chem_comp_atom.model_Cartn_z\nALA N 1 2 3\nALA CA 4 5 6\n"
    rows = S.atoms(spark.createDataFrame([("c.cif", text.encode())], "name string, content binary")).orderBy("pos").collect()
    assert [(r["model"], r["atom"], r["x"]) for r in rows] == [(2, "N", 1.0), (2, "CA", 4.0)]
    (tmp_path / "t.txt").write_text("1.5\nx\n -2\n")
    assert [r["angle"] for r in S.torsion_text(spark, str(tmp_path / "t.txt")).collect()] == [1.5, -2.0]
    assert S.output_target("a/b.pdb", None, "fcz", False) == "a/b.fcz" and S.output_target("a/b/", None, "fcz", True) == "a/b_fcz/"
    assert S.output_target("d", None, "fcz", True, archive=True) == "d.fcz.tar" and S.output_target("d", "e", "fcz", True) == "e" and S.output_target("d", None, "fcz", True, database=True) == "d_db"


def test_format_behind_long_comments(spark):
    comments = b"# a comment\n\n \t\r\n" * 20_000
    texts = {"cif": comments + b"DATA_x\nloop_", "mmjson": comments + b'{"data_x": {}}', "pdb": comments + b"ATOM      1", "entry": b"FCMP" + comments + b"{"}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "kind string, content binary")
    assert all(r["kind"] == r["found"] for r in rows.select("kind", S.sniff(rows["content"]).alias("found")).collect())


def test_fragments_are_encoded_in_batches(spark, texts):
    """No group in Python for each text: fragments come as arrays, many to a batch."""
    out = P.compress_texts(texts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
    twice = P.compress_texts(texts.unionByName(texts))
    assert sorted((r["name"], r["blob"]) for r in twice.collect()) == sorted((r["name"], r["blob"]) for r in out.collect())


def test_entries_together_are_as_one_by_one():
    from helixframe import api

    blobs = [api.compress(n, (DATA / "test_af.pdb").read_text(), anchor_residue_threshold=k) for n, k in (("a", 25), ("b", 7), ("c", 3))]
    assert api.decompress_many(blobs) == [api.decompress(b) for b in blobs]
    assert api.get_data_many(blobs) == [api.get_data(b) for b in blobs]
    assert api.decompress_many([]) == [] and api.get_data_many([]) == []


def test_batches_are_cut_by_their_bytes(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(S, "BATCH_BYTES", 100)
    frame = pd.DataFrame({"name": [str(k) for k in range(30)], "content": [None if k == 5 else b"x" * (250 if k == 7 else 30) for k in range(30)]})
    parts = list(S.in_pieces(iter([frame, frame.iloc[:0]])))
    assert [n for p in parts for n in p["name"]] == frame["name"].tolist()
    assert max(len(p) for p in parts) <= 6 and len(parts) > 8


def test_fragments_of_a_text_are_cut_within_its_row(spark, texts):
    """Atoms are not rows that windows sort; the fragments are those that windows over atom rows find, also where a residue comes up again and the text comes twice."""
    lines = (DATA / "test_af.pdb").read_text().splitlines()
    moved = [*lines[:40], *lines[60:120], *lines[40:60], *lines[130:]]  # numbers leave a gap, and a residue's atoms are apart
    odd = {"moved.pdb": moved, "models.pdb": ["MODEL        1", *lines[:-2], "ENDMDL", "MODEL        2", *lines], "ended.pdb": [*lines[:90], "END", *lines[90:]], "chains.pdb": [x[:21] + "B" + x[22:] if k > 100 else x for k, x in enumerate(lines)]}
    given = texts.unionByName(spark.createDataFrame([(n, bytearray("\r\n".join(x).encode())) for n, x in odd.items()], "name string, content binary"))
    out = P.compress_texts(given)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    wanted = {tuple(r) for r in P.fragments(S.atoms(given).filter("record = 'ATOM'")).groupBy("name", "model", "segment", "fragment").agg(F.count("*").alias("n")).select("name", "n").collect()}
    # A fragment that cannot be an entry has an error.
    assert {(r["source"], E.parse(bytes(r["blob"])).n_atom) for r in rows if r["error"] is None} <= wanted and len(rows) > len(wanted) / 2
    twice = P.compress_texts(given.unionByName(given)).collect()
    assert sorted(map(str, twice)) == sorted(map(str, rows))


def test_fragments_encoded_together_are_as_one_by_one():
    known = ["GLY", "TRP", "PRO", "ALA"]
    whole = [E.Atoms(*map(np.array, zip(*[(a, x, i + 1, 9) for i, x in enumerate(known) for a in E.dictionary()[x].atoms], strict=True)), np.empty(0), np.empty(0)) for _ in range(3)]
    for k, a in enumerate(whole):
        a.coord, a.temp = np.random.default_rng(k).normal(size=(len(a.atom), 3)), np.full(len(a.atom), 7.5 * k)
    whole[1].atom[9], whole[2].residue[:] = "OXT", "ODD"
    joined = E.Atoms(*(np.concatenate([getattr(a, c) for a in whole]) for c in ("atom", "residue", "number", "serial", "coord", "temp")))
    blobs, errors = E.encode_many(joined, np.cumsum([0, *(len(a.atom) for a in whole)]), ["a", "", "c"], ["A", None, "C"])
    assert errors == [None, None, "unknown residue ODD"] and blobs[2] is None
    whole[1].chain = ""
    assert blobs[:2] == [E.encode(whole[0], "a"), E.encode(whole[1], "")]


def test_entries_lie_in_many_partitions(spark, texts):
    """Small as they are, they are not put together in one task, in which all that is made of them would run."""
    entries = P.compress_texts(texts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts > 1 and entries.rdd.getNumPartitions() == E.extract(entries).rdd.getNumPartitions() == parts


def test_rows_of_atoms_are_made_for_many_entries_at_once(spark, texts, monkeypatch):
    """Columns of a batch, not a frame for each entry; entries with errors are rows between the others."""
    import pyarrow as pa

    blob = bytes(P.compress_texts(texts.filter("name = 'test_af.pdb'")).first()["blob"])
    monkeypatch.setattr("pandas.concat", None)
    made = E._atom_rows(pa.RecordBatch.from_arrays([pa.array(list("abcd")), pa.array([None, blob, b"x", blob], pa.binary())], names=["name", "blob"]), False)
    rows, atoms = made.to_pylist(), E.decode(E.parse(blob))
    assert [(r["name"], r["atom"], r["error"]) for r in (rows[0], rows[244])] == [("a", None, "no entry"), ("c", None, "not an entry")]
    for name, own in (("b", rows[1:244]), ("d", rows[245:])):
        assert {r["name"] for r in own} == {name} and [r["pos"] for r in own] == list(range(243)) and {r["error"] for r in own} == {None}
        assert [[r[c] for c in "xyz"] for r in own] == atoms.coord.tolist() and [r["atom"] for r in own] == atoms.atom.tolist() and [r["residue_index"] for r in own] == atoms.number.tolist()
