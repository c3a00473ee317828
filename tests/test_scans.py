"""Spread scans against the windows of one task, and how they are dealt out."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import report as P
from helixframe.operators import scans
from helixframe.operators import segments as M

SHAPE = "k string, j int, pos long, chain string, atom string, number long, _n string"


def rows_of(n, seed, keys):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.choice([None, 1]), i, rng.choice("AAAB") if rng.random() > 0.1 else None, rng.choice(["N", "CA", None]), rng.choice([None, i // 3, i // 2]), "x") for i in range(n)]


@pytest.fixture(scope="module", params=[(200, ["a", None, "b"]), (0, ["a"])])
def frame(spark, request):
    n, keys = request.param
    return spark.createDataFrame(rows_of(n, n, keys), SHAPE).repartition(3).cache()


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


KEYS = ["k", "j"]


@pytest.mark.parametrize("keys", [KEYS, []])
def test_spread_gives_the_same_rows(frame, keys):
    for run in (
        lambda spread: M.with_run_id(frame, keys, ["pos"], "chain", spread=spread),
        lambda spread: M.chain_segments(frame, keys, ["pos"], "chain", F.col("atom") == "N", spread=spread),
        lambda spread: M.gap_fragments(frame, keys, ["pos"], "number", F.col("atom") == "N", spread=spread),
        lambda spread: M.renumber(frame, keys, ["pos"], 7, spread=spread),
        lambda spread: P.joined(frame, keys, ["pos"], F.coalesce("atom", F.lit("-")), ",", spread=spread),
        lambda spread: M.collected(frame, keys, ["pos"], "chain", "chains", spread=spread),
    ):
        a, b = run(True), run(False)
        if a.columns != b.columns or not keys:  # without keys an aggregate of no rows has a row, a scan none
            a = a.select(b.columns)
            if frame.isEmpty():
                continue
        same(a, b)


def test_one_key_is_spread_over_all_ranges(spark):
    rows = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("pos"))
    dealt = scans.ranged(rows, ["k"], ["pos"])
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4
    assert M.renumber(rows, ["k"], ["pos"], spread=True).filter("number <> pos").isEmpty()


def test_rows_of_one_place_are_all_kept(spark):
    rows = spark.createDataFrame([("a", 1, "x")] * 500, "k string, pos long, chain string")
    assert sorted(r["number"] for r in M.renumber(rows, ["k"], ["pos"], spread=True).collect()) == list(range(500))
    assert {r["run_id"] for r in M.with_run_id(rows, ["k"], ["pos"], "chain", spread=True).collect()} == {0}


def test_pieces_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(scans, "MERGED", 2)
    rows = spark.range(500).select(F.lit(1).alias("k"), F.col("id").alias("pos"))
    assert P.joined(rows, ["k"], ["pos"], F.col("pos").cast("string"), ",", spread=True).first()["data"] == ",".join(map(str, range(500)))
