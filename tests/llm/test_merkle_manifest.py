"""The manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import merkle_manifest as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grow(nodes, arity):
    """The digest of a run of nodes, and each one's siblings on the way up, left to right."""
    proofs = [[] for _ in nodes]
    below = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for slot, members in enumerate(below[k : k + arity]):
                for m in members:
                    proofs[m].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            up.append(sha("".join(run)))
            held.append([m for members in below[k : k + arity] for m in members])
        nodes, below = up, held
    return nodes[0], proofs


def expected(rows, arity):
    """Sorted (doc_id, leaf, path, subroot, root) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = {}
    for g in order:
        leaves = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        held[g] = (leaves, *grow([x[1] for x in leaves], arity))
    root, upper = grow([held[g][1] for g in order], arity)
    return sorted(
        ((d, h, tuple(path + upper[k]), held[g][1], root) for k, g in enumerate(order) for (d, h), path in zip(held[g][0], held[g][2], strict=True)), key=repr
    )


def rows_of(n, seed):
    rng = random.Random(seed)
    langs = ["en"] * 6 + [None, "", "é", "=x", "de", "zz"]
    rows = [(rng.randrange(n) if rng.random() > 0.1 else None, rng.choice([None, "s", "-"]), rng.choice(langs), rng.choice([None, 0, 7, 2**63 - 1]), rng.choice([None, "", "-", "a:b", "é" * 5000])) for _ in range(n)]
    return rows + rows[: n // 5]


@pytest.mark.parametrize(("arity", "levels", "n"), [(2, 2, 70), (2, 8, 300), (3, 1, 50), (3, 2, 90)])
def test_equals_a_tree_in_python(spark, arity, levels, n):
    """Also with blocks of a few leaves, so that there are several rounds, and with runs of three."""
    rows = rows_of(n, n)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, key string, idx int").repartition(3)
    out = M.manifest(docs, arity=arity, levels=levels)
    got = out.withColumn("back", M.folded(F.col("leaf"), F.col("path"))).withColumn("proof", M.proof_digest(F.col("path"))).collect()
    assert sorted(((r["doc_id"], r["leaf"], tuple((p["left"], p["right"]) for p in r["path"]), r["subroot"], r["root"]) for r in got), key=repr) == expected(rows, arity)
    assert all(r["back"] == r["root"] and r["proof"] == sha("".join(p["left"] + p["right"] for p in r["path"])) for r in got)


def test_one_row_and_none(spark):
    shape = "doc_id long, source string, lang string, n_chars long, text string"
    one = M.manifest(spark.createDataFrame([(None, None, None, None, None)], shape)).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["path"], r["lang"]) for r in one] == [(sha("-----"),) * 3 + ([], None)]
    assert M.manifest(spark.createDataFrame([], shape)).count() == 0


def test_query_finds_tampered_rows(spark, tmp_path):
    import zlib

    rows = [(i, "s", "en" if i % 3 else None, None if i % 5 == 0 else i, f"t{i}") for i in range(120)] + [(None, None, "en", 3, "x")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = M.op11_merkle_manifest(spark, str(tmp_path)).collect()
    hit = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["doc_id"] % 5 != 0
    assert len(out) == len(rows)
    assert all(r["verified"] == (not hit(r)) for r in out) and any(hit(r) for r in out)
