"""Archives by ranges, selection, the index cache, the table function, observed metrics and repeats across batches."""

from __future__ import annotations

import io
import random
import tarfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe.functions import tables
from helixframe.operators import lookup as L
from helixframe.plans import structures as P
from helixframe.sources import archive_format as A
from helixframe.sources import keyed_db as K
from helixframe.sources import structures as S
from helixframe.streaming.ingest import ingest

DATA = Path(__file__).resolve().parent / "data"


def packed(path, form=tarfile.GNU_FORMAT, mode="w"):
    rng = random.Random(4)
    with tarfile.open(path, mode, format=form) as archive:
        for k in range(120):
            info = tarfile.TarInfo(("long/" * 40 if k % 5 == 0 else "d/") + f"é{k}.pdb")
            content = bytes(rng.randrange(256) for _ in range(rng.choice([0, 3, 600, 5000])))
            if k % 7 == 0:
                info.type = tarfile.DIRTYPE
                archive.addfile(info)
                continue
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))


def held(rows):
    return sorted((r["entry"], r["name"], None if r["content"] is None else bytes(r["content"])) for r in rows.collect())


@pytest.mark.parametrize("form", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
@pytest.mark.parametrize("split", [1, 9000, 1 << 30])
def test_ranges_give_the_members(spark, tmp_path, form, split):
    path = str(tmp_path / "a.tar")
    packed(path, form)
    wanted = S.opened(spark.read.format("binaryFile").load(path))
    rows = A.load(spark, path, split)
    assert held(rows) == held(wanted) and len(held(rows)) > 100
    assert (rows.rdd.getNumPartitions() > 10) == (split < 10_000)


def test_tasks_find_the_headers(spark, tmp_path, monkeypatch):
    """Members hold archives, whose headers are none of the outer one's; what tasks find is what one walk finds."""
    packed(str(tmp_path / "in.tar"))
    inner = (tmp_path / "in.tar").read_bytes()
    with tarfile.open(tmp_path / "a.tar", "w", format=tarfile.GNU_FORMAT) as archive:
        for k in range(40):
            info = tarfile.TarInfo("long/" * 40 + str(k))
            content = inner[: 30_000 * (k % 4)]
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
    path = str(tmp_path / "a.tar")
    for split in (512, 20_000):
        assert A.ranges(path, split, spark) == A.ranges(path, split)
    got = [(r["name"], len(r["content"])) for r in A.load(spark, path, 20_000).collect()]
    assert sorted(got) == sorted(("long/" * 40 + str(k), 30_000 * (k % 4)) for k in range(40))
    alone = []
    monkeypatch.setattr(A, "walked", lambda *given: alone.append(given) or ([given[1]], -1, [0, 0]))
    packed(str(tmp_path / "b.tar"))
    monkeypatch.setattr(A, "RANGES", 10)
    found = A.ranges(str(tmp_path / "b.tar"), 512, spark)
    assert len(found) == 10 and not alone  # the driver walks no header, and ranges stay few


def test_compressed_and_broken_archives(spark, tmp_path):
    packed(str(tmp_path / "a.tgz"), mode="w:gz")
    assert held(A.load(spark, str(tmp_path / "a.tgz"))) == held(S.opened(spark.read.format("binaryFile").load(str(tmp_path / "a.tgz"))))
    packed(str(tmp_path / "b.tar"))
    whole = (tmp_path / "b.tar").read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "c.tar").write_bytes(whole[: len(whole) // 2 + 100])
    (tmp_path / "cut" / "junk.tar").write_bytes(b"x" * 3000)
    for split in (4096, 1 << 30):
        rows = held(A.load(spark, str(tmp_path / "cut"), split))
        broken = [r for r in rows if r[2] is None]
        assert [r[1] for r in broken] == ["c.tar", "junk.tar"] and 30 < len(rows) < 100
    with tarfile.open(tmp_path / "none.tar", "w"):
        pass
    assert held(A.load(spark, str(tmp_path / "none.tar"))) == []


@pytest.mark.parametrize("seed", range(3))
def test_selection_is_the_sorts(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(30)]), rng.choice(["a", "b", None]), rng.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, c double").cache()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))
    for place in (0, 1, 1499, 2999, -1, -3000, 1234):
        assert tuple(L.at_index(df, ["a", "b", "c"], place, most=50).first()) == order[place]
    assert L.at_index(df, ["a", "b", "c"], 3000, most=50).isEmpty() and L.at_index(df, ["a"], -3001).isEmpty()
    assert L.at_index(df, ["b"], 2500, most=50).first()["b"] == sorted(rows, key=lambda r: (r[1] is not None, r[1] or ""))[2500][1]


def test_selection_among_equal_rows(spark):
    df = spark.range(500).select(F.lit(3).alias("a"))
    assert L.at_index(df, ["a"], 400, most=10).first()["a"] == 3


def test_places_are_found_by_a_few_counts(spark, monkeypatch):
    """All places in one scan a round, and comparisons with two values for each, not with 64; few values that come often are parted too."""
    monkeypatch.setattr(L, "SAMPLED", 400)
    counted = []
    agg = type(spark.range(1)).agg
    monkeypatch.setattr(type(spark.range(1)), "agg", lambda self, *c: (counted.append(len(c)), agg(self, *c))[1])
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("a"), (F.col("id") % 2).alias("b"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("c")).cache()
    places = [0, 1999, -1, 777, -778, 2000, -2001]
    assert {r["at"]: r["a"] for r in L.at_indices(df, ["a"], places, "at", most=20).collect()} == {0: 0, 1999: 1999, -1: 1999, 777: 777, -778: 1222}
    assert len(counted) < 12 and max(counted) <= 2 * len(places)
    assert {r["at"]: (r["c"], r["b"]) for r in L.at_indices(df, ["c", "b"], [0, 400, 700, -1], "at", most=1).collect()} == {0: (None, 0), 400: (None, 1), 700: (1, 0), -1: (2, 1)}


def test_a_dictionary_is_sent_to_the_rows(spark):
    rows = spark.range(3000).select("id", F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int")).alias("flag"))
    names = spark.createDataFrame([("A", "accepted"), ("N", "none"), ("R", "returned")], "flag string, label string")
    out = L.with_dictionary(rows, names, "flag", strict=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert out.groupBy("label").count().count() == 3 and out.count() == 3000


def test_the_cached_index_is_not_dealt_out(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i:03d}", f"c{i}".encode()) for i in range(300)], "name string, content binary")
    path = str(tmp_path / "db")
    K.write_native(rows, path)
    index = K.cached_index(spark, path)
    keys = spark.range(0, 600, 3).select(F.col("id").alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = keys.join(index.hint("merge"), "key")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert K.cached_index(spark, path).inputFiles() == index.inputFiles()
    by_name = K.read_native(spark, path, ["n007", "n001", "n007"], cached=True)
    assert [(r["ord"], bytes(r["content"])) for r in by_name.orderBy("ord").collect()] == [(0, b"c7"), (1, b"c1"), (2, b"c7")]
    K.write_native(rows.limit(7), path, overwrite=True)
    assert K.cached_index(spark, path).count() == 7


def test_split_in_sql(spark):
    tables.register(spark)
    lines = [("t1", 0, "A", "a"), ("t1", 1, "A", None), ("t1", 2, None, "b"), ("t1", 3, None, "c"), ("t1", 4, "A", "d"), ("t2", 0, "A", "e"), (None, 0, "B", "f")]
    spark.createDataFrame(lines, "text string, line_no int, chain string, text_line string").createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT * FROM split_by_chain(TABLE(some_lines) PARTITION BY text ORDER BY line_no)").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("t1", 0, "A", "a"), ("t1", 1, None, "b\nc"), ("t1", 2, "A", "d"), ("t2", 0, "A", "e"), (None, 0, "B", "f")], key=repr)


def test_what_a_run_observes(spark):
    texts = S.entries(spark, str(DATA)).unionByName(spark.createDataFrame([("x", "x", "none.pdb", bytearray(b""))], "path string, entry string, name string, content binary"))
    made, seen = P.observed(P.compress_texts(texts, timed=True), "compress")
    rows = made.collect()
    counts = seen.get
    assert counts["rows"] == len(rows) == 6 and counts["errors"] == 1 and counts["bytes"] == sum(len(r["blob"] or b"") for r in rows)
    assert 0 < counts["longest"] <= counts["seconds"] and abs(counts["seconds"] - sum(r["seconds"] for r in rows)) < 1e-6


def test_a_content_that_comes_twice_gives_one_entry(spark, tmp_path):
    text = (DATA / "test_af.pdb").read_bytes()
    folder, places = tmp_path / "in", [str(tmp_path / x) for x in ("in", "out", "cp")]
    folder.mkdir()
    (folder / "a.pdb").write_bytes(text)
    ingest(spark, *places).awaitTermination()
    (folder / "b.pdb").write_bytes(text)
    (folder / "c.pdb").write_bytes(text.replace(b"ALA", b"GLY"))
    ingest(spark, *places).awaitTermination()
    rows = spark.read.parquet(f"{places[1]}").collect()
    assert sorted(r["source"] for r in rows) == ["a.pdb", "c.pdb"]
