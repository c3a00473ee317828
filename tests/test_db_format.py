"""The Spark format of databases: ranges, pushed filters, strict ids, and files that appear together or not at all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixframe.sources import db_format as D
from helixframe.sources import keyed_db as K
from helixframe.sources.shared import local_path


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(1)
    rows = [(f"n{i:04d}" if i % 50 else f"é {i}", bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 40, 900])))) for i in range(700)]
    return spark.createDataFrame(rows, "name string, content binary").repartition(5).cache()


@pytest.fixture(scope="module")
def path(entries, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("db") / "native")
    K.write_native(entries, out)
    return out


def held(rows):
    return sorted((r["key"], r["name"], bytes(r["content"])) for r in rows.collect())


@pytest.mark.parametrize("split", [7, 100, 4096, 1 << 20])
def test_ranges_give_every_entry_once(spark, path, split):
    rows = D.load(spark, path, split=split)
    assert held(rows) == held(K.read_native(spark, path))
    if split == 4096:
        assert rows.rdd.getNumPartitions() > 1


def test_keys_and_names(spark, path):
    every = held(K.read_native(spark, path))
    assert held(D.load(spark, path, keys=[699, 3, 10**9, 0], split=64)) == [every[k] for k in (0, 3, 699)]
    assert held(D.load(spark, path, names=["é 50", "n0001", "nobody"])) == [e for e in every if e[1] in ("é 50", "n0001")]
    assert held(D.load(spark, path, keys=[])) == [] and held(D.load(spark, path, names=[])) == []
    with pytest.raises(KeyError, match="nobody"):
        D.load(spark, path, names=["n0001", "nobody"], strict=True)
    with pytest.raises(Exception, match="1000000000"):
        D.load(spark, path, keys=[3, 10**9], strict=True).collect()


def test_filters_are_pushed_down(spark, path):
    every = held(K.read_native(spark, path))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for condition, keep in (
            ("key = 5", lambda k, n: k == 5), ("key IN (1, 2, 900)", lambda k, n: k in (1, 2)), ("key >= 690", lambda k, n: k >= 690), ("key > 3 AND key <= 9", lambda k, n: 3 < k <= 9),
            ("name = 'n0007'", lambda k, n: n == "n0007"), ("key < 40 AND name IN ('n0030', 'n0300')", lambda k, n: n == "n0030" and k < 40), ("length(content) > 100 AND key < 99", lambda k, n: k < 99),
        ):
            rows = D.load(spark, path, split=256).filter(condition)
            wanted = [e for e in every if keep(e[0], e[1]) and ("length" not in condition or len(e[2]) > 100)]
            assert held(rows) == wanted
        few = D.load(spark, path, split=256).filter("key = 5").rdd.getNumPartitions()
        assert few == 1 < D.load(spark, path, split=256).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_failed_write_leaves_no_file(spark, entries, tmp_path):
    target = str(tmp_path / "db")
    parts = entries.select(F.lit("").alias("file"), F.lit(0).alias("offset"), F.when(F.col("name") == "n0333", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        D.save(parts, {"": 10**6}, target)
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(Exception, match="bytes for a file of"):
        D.save(entries.select(F.lit("").alias("file"), F.lit(0).alias("offset"), "content"), {"": 5}, target)
    assert list(tmp_path.iterdir()) == []


def test_overwriting_is_asked_for(spark, entries, tmp_path):
    target = str(tmp_path / "db")
    K.write_native(entries.limit(3), target)
    with pytest.raises(FileExistsError):
        K.write_native(entries, target)
    assert D.load(spark, target).count() == 3
    K.write_native(entries.limit(5), target, overwrite=True)
    assert D.load(spark, target).count() == 5 and len(list(tmp_path.iterdir())) == 4
    K.write_native(entries.limit(0), str(tmp_path / "none"))
    assert D.load(spark, str(tmp_path / "none")).count() == 0


def test_local_paths():
    assert local_path("file:///a/b") == local_path("file:/a/b") == local_path("/a/b") == "/a/b" and local_path("a:b/c") == "a:b/c"
    for other in ("hdfs://host/a", "s3a://bucket/a", "viewfs://store/in"):
        with pytest.raises(ValueError, match="mounted"):
            local_path(other)
