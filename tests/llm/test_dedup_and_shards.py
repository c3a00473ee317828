from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import chunk_recipes as R
from helixframe.llm import two_pass_shuffle as S
from helixframe.llm.common import sum_before


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(docs, bits):
    """Also with three bits of hash, where most chunks clash and only verification tells them apart."""
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r["text"])].append(r["doc_id"])
    wanted = []
    for r in rows:
        g = groups[lower(r["text"])]
        keep = max((x for x in g if x is not None), default=None)
        wanted.append((r["doc_id"], keep, len(g), r["doc_id"] == keep, hashlib.sha256(lower(r["text"]).encode()).hexdigest()))
    got = [tuple(r)[:5] for r in R.exact_dedup(docs, shortest=8, longest=64, hash_bits=bits).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_chunks_join_to_the_text(spark, docs):
    held = docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", R.chunks_of(F.col("t"), 8, 64).alias("c"))
    assert held.filter(F.array_join("c", "") != F.col("t")).count() == 0


def test_empty_tables(no_docs):
    assert R.exact_dedup(no_docs).count() == 0
    assert S.shuffle_into_shards(no_docs).count() == 0


@pytest.mark.parametrize("size", [1 << 30, 4096])
def test_shards(docs, size):
    out = S.shuffle_into_shards(docs, shards=5, bucket_bytes=size)
    rows = out.collect()
    assert sorted((tuple(r["record"]) for r in rows), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    slots = defaultdict(list)
    for r in rows:
        slots[r["_shard"]].append(r["_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[k]) for k in range(5)]
    assert max(counts) - min(counts) <= 1
    again = {(tuple(r["record"])[0], r["_shard"], r["_slot"]) for r in S.shuffle_into_shards(docs, shards=5, bucket_bytes=size).collect()}
    assert again == {(tuple(r["record"])[0], r["_shard"], r["_slot"]) for r in rows}
    other = [(r["_shard"], r["_slot"]) for r in S.shuffle_into_shards(docs, shards=5, seed=18, bucket_bytes=size).orderBy("record.doc_id").collect()]
    assert other != [(r["_shard"], r["_slot"]) for r in out.orderBy("record.doc_id").collect()]


def test_shards_of_rows_with_maps(spark):
    """Maps, also within arrays and structs, come out as they went in."""
    rows = [(k, f"t{k}" if k % 3 else None, {"a": k, "b": None} if k % 4 else None, [{"x": "y" * k}, None], ({1: 2.0},)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, l array<map<string,string>>, s struct<i: map<int,double>>")
    out = S.shuffle_into_shards(df, shards=3, bucket_bytes=100)
    assert out.select("record.*").schema == df.schema
    assert sorted((tuple(r["record"]) for r in out.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_sums_before(spark):
    rows = [(k * 3, k % 5) for k in range(200)]
    got = dict(map(tuple, sum_before(spark.createDataFrame(rows, "k long, v long"), "k", "v", "b", block=7).collect()))
    assert got == {k: sum(v for j, v in rows if j < k) for k, _ in rows}


def test_written_shards(spark, plain_docs, tmp_path):
    S.write_shards(S.shuffle_into_shards(plain_docs, shards=3), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == plain_docs.count() and back.select("_shard").distinct().count() == 3


def test_rows_that_are_alike_go_to_many_buckets(spark):
    """Also where they are all there is: tasks are even, the law and the slots hold."""
    df = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("x" * 100).alias("text")).repartition(3)
    out = S.shuffle_into_shards(df, shards=7, bucket_bytes=4000)
    sizes = [n for n in out.rdd.glom().map(len).collect() if n]
    assert len(sizes) >= 4 and max(sizes) < 2 * 4000 / len(sizes)
    slots = defaultdict(list)
    for r in out.select("_shard", "_slot").collect():
        slots[r["_shard"]].append(r["_slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
