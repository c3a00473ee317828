"""Databases, archives, file lists and the command line; what was lost or broke before has a test each."""

from __future__ import annotations

import gzip
import json
import struct
import tarfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe import api, cli
from helixframe.operators import entry_codec as E
from helixframe.operators import lookup as L
from helixframe.plans import structures as P
from helixframe.sources import keyed_db as K
from helixframe.sources import shared
from helixframe.sources import structures as S

DATA = Path(__file__).parent / "data"


@pytest.fixture
def coalescing(spark):
    """Partitions of a few kilobytes, so that adaptive execution joins many of them, each reading in its own way."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_no_entry_is_lost(spark, tmp_path, coalescing):
    rows = spark.range(3000).select(F.format_string("e%05d", (F.col("id") * 7919) % 3000).alias("name"), F.repeat(F.format_string("%07d,", "id"), (F.col("id") % 500 + 1).cast("int")).cast("binary").alias("content"))
    K.write(rows, str(tmp_path / "db"))
    back = K.read(spark, str(tmp_path / "db"))
    index = K.read_index(spark, str(tmp_path / "db/index"))
    assert back.count() == index.count() == K.read_lookup(spark, str(tmp_path / "db/lookup")).count() == 3000
    assert back.join(rows, ["name", "content"]).count() == 3000
    at = 0
    for k, r in enumerate(index.orderBy("key").collect()):
        assert (r["key"], r["offset"]) == (k, at)
        at += r["length"]
    K.write_native(rows, str(tmp_path / "plain"))
    native = K.read_native(spark, str(tmp_path / "plain"))
    assert native.join(rows, ["name", "content"]).count() == 3000 and (tmp_path / "plain").stat().st_size == at
    assert (tmp_path / "plain.dbtype").read_bytes() == struct.pack("<i", 12)
    lines = (tmp_path / "plain.lookup").read_text().splitlines()
    assert lines == [f"{k}\te{k:05d}\t0" for k in range(3000)]


def test_database_object(spark, tmp_path):
    rows = spark.createDataFrame([("b", b"22", 9), ("a", b"1", 4), ("c", b"333", 2)], "name string, content binary, k long")
    K.write_native(rows, str(tmp_path / "n"), key="k")
    assert (tmp_path / "n.index").read_text() == "2\t0\t3\n4\t3\t1\n9\t4\t2\n"
    K.write(rows, str(tmp_path / "f"))
    for path, order in (("n", ["c", "a", "b"]), ("f", ["a", "b", "c"])):
        with api.open_database(spark, str(tmp_path / path)) as db:
            assert len(db) == 3 and [db[k][0] for k in range(3)] == order and db[-1][0] == order[-1] and db["c"] == ("c", b"333")
            with pytest.raises(IndexError):
                db[3]
            with pytest.raises(KeyError):
                db["d"]
        with pytest.raises(ValueError):
            db.entries()
        some = api.open_database(spark, str(tmp_path / path), ["c", "a"])
        assert len(some) == 2 and some[0] == ("c", b"333") and some.entries().count() == 2
        with pytest.raises(KeyError):
            api.open_database(spark, str(tmp_path / path), ["nobody"], err_on_missing=True)


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for k, name in enumerate(("test_af.pdb", "test.pdb")):
        (tmp_path / "in" / str(k)).mkdir(parents=True)
        (tmp_path / "in" / str(k) / "x.pdb").write_bytes((DATA / name).read_bytes())
    found = S.entries(spark, str(tmp_path / "in"), recursive=True)
    out = P.compress_texts(found).select("name", "entry", "error", F.octet_length("blob").alias("n")).collect()
    assert [r["name"] for r in out] == ["x.fcz"] * 2 and len({r["entry"] for r in out}) == 2 and all(r["error"] is None for r in out)
    assert {r["n"] for r in S.atoms(found).groupBy("entry").agg(F.count("*").alias("n")).collect()} == {243, 2208}


def test_bad_inputs_are_rows(spark, tmp_path):
    raw = (DATA / "test_af.pdb").read_bytes()
    bad = {"empty.pdb": b"", "json.json": b"{not json", "list.json": b"[1, 2]", "cif.cif": b"data_x loop_ _atom_site.id", "junk.pdb": bytes(range(256)), "cut.gz": gzip.compress(raw)[:-9], "no.tar": b"x" * 600, "null": None, "good.pdb": raw}
    frame = S.opened(spark.createDataFrame([(k, bytearray(v)) for k, v in bad.items() if v is not None], "path string, content binary"))
    frame = frame.unionByName(spark.createDataFrame([("null", "null", "null", None)], frame.schema))
    out = {r["source"]: r["error"] for r in P.compress_texts(frame).collect()}
    assert len(out) == len(bad) and [k for k, v in out.items() if v is None] == ["good.pdb"]
    blob = P.compress_texts(frame.filter("name = 'good.pdb'")).first()["blob"]
    entries = spark.createDataFrame([("a", blob), ("b", blob[:-3]), ("c", b"FCMP"), ("d", None), ("e", blob[:300]), ("a", blob)], "name string, blob binary")
    got = sorted((r["name"], r["text"] is not None, r["error"]) for r in P.decompress_texts(entries).collect())
    assert [x[:2] for x in got] == [("a", True), ("a", True), ("b", False), ("c", False), ("d", False), ("e", False)] and all((x[2] is None) == x[1] for x in got)
    assert E.decompress(entries).filter("error is not null").count() == 4
    checked = {r["name"]: r["outcome"] for r in P.check_entries(entries).collect()}
    assert checked["a"] == "SUCCESS" and checked["b"] == "E_TEMP_FACTOR_COUNT_MISMATCH" and checked["e"] == "E_BACKBONE_COUNT_MISMATCH" and checked["c"] == "too short"
    assert E.check(bytes(blob[: len(blob) - 28 - 8 - 5])) == "E_SIDECHAIN_COUNT_MISMATCH"


def test_last_oxygen_has_its_residues_number(spark):
    rows = S.pdb_atoms(S.entries(spark, str(DATA / "test_af.pdb"))).withColumn("residue_index", F.col("residue_index") + 100)
    blob = E.encoded(rows.toPandas(), "x", 25)[0]
    entry = E.parse(blob)
    assert E.decode(entry).number[-1] == 128 and E.decode(entry, number_oxt=False).number[-1] == 28
    alone, together = E.decode(entry), E.decode_many([entry, entry])
    assert all((x.coord == alone.coord).all() and (x.atom == alone.atom).all() for x in together)


def test_titles(spark):
    block = {"data_x": {"struct": {"title": ["A title"]}}}
    pdb = b"HEADER    SOMETHING" + b" " * 43 + b"1ABC\nTITLE     LONG\nTITLE    2 ER\nATOM"
    frame = spark.createDataFrame([("a.json", json.dumps(block).encode()), ("d/b.pdb", b"ATOM"), ("c.pdb", pdb), ("e.pdb", b"TITLE     LONG\nTITLE    2 ER\nATOM"), ("f.cif", b"data_x\n_entry.id 2XYZ\n"), ("g.json", b"{bad")], "name string, content binary")
    got = {r["name"]: r["title"] for r in S.titles(frame).collect()}
    assert got == {"a.json": "A title", "d/b.pdb": "d/b.pdb", "c.pdb": "1ABC", "e.pdb": "LONG ER", "f.cif": "2XYZ", "g.json": "g"}


def test_places_and_slices(spark):
    df = spark.range(20).withColumnRenamed("id", "pos")
    assert L.at_index(df, ["pos"], 3).first()[0] == 3 and L.at_index(df, ["pos"], -1).first()[0] == 19 and L.at_index(df, ["pos"], 20).count() == 0
    ranges = spark.createDataFrame([(0, 2), (5, 5), (18, 30)], "begin long, end long")
    assert sorted(r["pos"] for r in L.slices(df, ranges).collect()) == [0, 1, 18, 19] and L.slices(df, None).count() == 20


def test_shared_dir_is_asked_for_on_a_cluster():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Fake)


def test_command_line(spark, tmp_path, capsys):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "deep").mkdir(parents=True)
    for name in ("test.pdb", "test_af.pdb"):
        (source / name).write_bytes((DATA / name).read_bytes())
    (source / "deep" / "multichain.pdb").write_bytes((DATA / "multichain.pdb").read_bytes())
    go = lambda *a: cli.run([str(x) for x in a], spark)
    assert go("compress", "-r", source, out) == 0
    assert sorted(p.name for p in out.iterdir()) == ["multichainA.fcz", "multichainB_0.fcz", "multichainB_1.fcz", "test.fcz", "test_af.fcz"]
    assert go("compress", source, out) == 1 and "exists already" in capsys.readouterr().err
    assert go("compress", "-y", "--time", source, out) == 0 and "compress\t" in capsys.readouterr().out
    assert go("compress", source / "test.pdb", tmp_path / "one.fcz") == 0
    assert go("decompress", tmp_path / "one.fcz", tmp_path / "one.pdb") == 0
    assert go("rmsd", source / "test.pdb", tmp_path / "one.pdb") == 0
    fields = capsys.readouterr().out.strip().split("\t")
    assert fields[2:4] == ["276", "2208"] and abs(float(fields[5]) - 0.0826751) < 0.001
    assert go("compress", "-d", source, tmp_path / "db") == 0 and (tmp_path / "db.lookup").read_text() == "0\ttest\t0\n1\ttest_af\t0\n"
    (tmp_path / "ids").write_text("test_af\n")
    assert go("extract", "-l", tmp_path / "ids", tmp_path / "db", tmp_path / "scores") == 0
    assert (tmp_path / "scores").read_text() == ">test_af\n5666777787777787777777776665\n"
    assert go("extract", "--fasta", "--no-merge", tmp_path / "db", tmp_path / "fasta") == 0 and len(list((tmp_path / "fasta").iterdir())) == 2
    assert go("extract", "-p", "4", tmp_path / "db", tmp_path / "tsv") == 0 and (tmp_path / "tsv").read_text().splitlines()[1].startswith("test_af\t28\t56.93,")
    assert go("compress", "-z", source, tmp_path / "all.tar") == 0 and tarfile.open(tmp_path / "all.tar").getnames() == ["test.fcz", "test_af.fcz"]
    assert go("decompress", "--check", "-a", tmp_path / "all.tar", tmp_path / "texts") == 0 and len(list((tmp_path / "texts").iterdir())) == 2
    (tmp_path / "list").write_text(f"{out}/test.fcz\n{tmp_path}/all.tar\n")
    capsys.readouterr()
    assert go("check", "-f", tmp_path / "list") == 0 and capsys.readouterr().out.count("is valid") == 3
    (tmp_path / "broken.fcz").write_bytes((out / "test.fcz").read_bytes()[:-1])
    assert go("check", tmp_path / "broken.fcz") == 1 and "confidence values" in capsys.readouterr().out
    assert go("decompress", tmp_path / "nothing") == 1 and go("rmsd", source / "test.pdb") == 1
