"""The pipeline's stages, each on what the one before kept, against plain computations."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline as P
from helixframe.llm import qda_quality as Q
from test_dedup_and_shards import lower
from test_pairs_and_repeats import expected

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(spark, stages):
    scores = Q.quality(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in stages[1].select("doc_id").collect()} == {r["doc_id"] for r in scores.filter("score >= 0.3").collect()}


def test_exact(stages):
    best = {}
    for r in stages[1].collect():
        key = lower(r["text"])
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(best.values())


def test_near(stages):
    classes = expected([(r["doc_id"], r["text"]) for r in stages[2].collect()])
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(d for d, c, _ in classes if d == c)


def test_mixing(stages):
    before, after = [{}, {}], [{}, {}]
    for held, rows in ((before, stages[3]), (after, stages[4])):
        for r in rows.collect():
            held[0][r["source"]] = held[0].get(r["source"], 0) + len(r["text"].encode().split())
            held[1][r["doc_id"]] = held[1].get(r["doc_id"], 0) + 1
    assert after[1].keys() == before[1].keys() and set(after[1].values()) <= {1, 2, 3}
    shares = [after[0][s] / before[0][s] for s in before[0]]
    assert min(shares) >= 1 and max(shares) < 2.5


def test_packing(stages):
    rows = stages[5].collect()
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) >= sum(r["length"] for r in rows if r["start"] == 0)
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert sum(1 for r in rows if r["start"] == 0) == stages[4].count()


def test_run_is_the_stages(spark, stages):
    assert P.run(spark, SF).count() > 0


@pytest.fixture(scope="module")
def awkward_docs(spark, docs):
    """The awkward rows, and ids that repeat with other texts: one kept, the other rejected."""
    more = [(1, "a text of its own", "s0", "r", 1, "b"), (9, "one", "s1", "r", 2, "b"), (None, "Unique and clean", None, "r", 3, "b"), (None, docs.filter("doc_id = 9").first()["text"], "s1", "r", 4, "b")]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_exact_on_awkward_rows(spark, awkward_docs):
    rows = pairs(awkward_docs)
    best = {}
    for d, t in rows:
        key = lower(t or "")
        best[key] = max(best.get(key, -1), -1 if d is None else d)
    out = P.exact_stage(spark, awkward_docs, SF)
    assert out.columns == awkward_docs.columns
    assert pairs(out) == [(d, t) for d, t in rows if (-1 if d is None else d) == best[lower(t or "")]]


def test_near_on_awkward_rows(spark, awkward_docs):
    rows = pairs(awkward_docs)
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    heads = [named[k][0] for k, (_, c, _) in enumerate(expected([(k, t) for k, (_, t) in enumerate(named)])) if c == k]
    out = P.near_stage(spark, awkward_docs, SF)
    assert out.columns == awkward_docs.columns
    got = pairs(out)
    assert [r for r in got if r[0] is None] == [r for r in rows if r[0] is None]
    assert sorted(d for d, _ in got if d is not None) == heads


def test_other_stages_on_awkward_rows(spark, awkward_docs):
    kept = P.quality_stage(spark, awkward_docs, SF)
    assert kept.columns == awkward_docs.columns and set(pairs(kept)) <= set(pairs(awkward_docs))
    scores = Q.quality(awkward_docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept.count() == scores.filter("score >= 0.3").count()
    assert set(pairs(P.mixing_stage(spark, awkward_docs, SF))) == set(pairs(awkward_docs))
    assert P.packing_stage(spark, awkward_docs, SF).filter("start = 0").count() == awkward_docs.count()


@pytest.mark.parametrize("k", range(5))
def test_stages_of_empty_tables(spark, no_docs, k):
    out = P.STAGES[k][1](spark, no_docs, SF)
    assert out.count() == 0 and (k == 4 or out.columns == no_docs.columns)
