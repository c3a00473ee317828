from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from helixframe.llm import ctw_scoring as C
from helixframe.llm import qda_quality as Q
from helixframe.llm import trie_counts as T


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 1, (300, Q.D)), 1: rng.normal(0.5, 2, (400, Q.D))}
    x[0][:, 0], x[1][:, 0] = 8 + x[0][:, 0] * 0.1, 8 + x[1][:, 0] * 0.1
    m = Q.fit({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()}, 0.0, 0.0, 1.0)
    point = x[1][:5]
    logs = []
    for k in (0, 1):
        mean, cov = x[k].mean(0), np.cov(x[k].T, bias=True)
        d = point - mean
        logs.append(-0.5 * (d @ np.linalg.inv(cov) * d).sum(1) - 0.5 * np.linalg.slogdet(cov)[1])
    words = np.expm1(point[:, 0])
    z = words / (words + Q.SHORT) * (logs[1] - logs[0]) + math.log(400 / 300)
    assert np.allclose(m.score(point), 1 / (1 + np.exp(-np.clip(z, -60, 60))), atol=1e-9)


def plain_statistics(text: str | None) -> list[float]:
    b = (text or "").encode()
    words = b.split()
    if not words:
        words = []
    n, chars = len(words), [chr(c) for c in b]
    share = lambda f: sum(map(f, chars)) / max(len(b), 1)
    lines = [x for x in b.split(b"\n") if x]
    counts = Counter(b)
    entropy = -sum(k / len(b) * math.log2(k / len(b)) for k in counts.values())
    low = lambda c: ord(c) < 128
    symbol = lambda c: 33 <= ord(c) < 127 and not c.isalnum() and c not in ".,;:'\"-()?"
    of_words = [
        math.log1p(n), math.log(sum(map(len, words)) / n), len(set(words)) / n**0.8, math.log(len(b) / len(lines)), math.sqrt(1 - len(set(lines)) / len(lines)),
        math.sqrt(max(Counter(words).values()) / n), math.sqrt(sum(len(w) <= 3 for w in words) / n), math.sqrt(sum(len(w) > 14 for w in words) / n),
    ] if n else [0.0] * 8
    roots = [math.sqrt(share(f)) for f in (lambda c: low(c) and c.isupper(), lambda c: low(c) and c.isdigit(), lambda c: c in ".,", symbol, lambda c: c == "!", lambda c: c == "|")]
    return [*of_words[:3], share(lambda c: not low(c) or c.isalpha()), *roots[:5], of_words[3], of_words[4], of_words[5], of_words[6], entropy, roots[5], of_words[7]]


def test_statistics_against_plain_ones(docs):
    for r in docs.select("text").collect():
        got = Q.statistics([r["text"].encode() if r["text"] is not None else None])[0]
        assert got == pytest.approx(plain_statistics(r["text"]), abs=1e-9)


def test_fit_of_summed_rows(spark, plain_docs):
    """Means, shrunk covariances and odds from Spark's sums, against numpy over the labelled training rows."""
    rows = {r["doc_id"]: r["text"] for r in plain_docs.collect()}
    labels = [(i, i % 3 % 2) for i in rows if i % 4] + [(None, 1), (1, None), (10**9, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = [(plain_statistics(rows[i]), y) for i, y in labels if i in rows and y is not None and zlib.crc32(str(i).encode()) % 5 != 0]
    x = {k: np.array([v for v, y in kept if y == k]) for k in (0, 1)}
    for few in (1 << 20, 0):
        Q.FEW_LABELS, before = few, Q.FEW_LABELS
        m = Q.trained(plain_docs, frame)
        Q.FEW_LABELS = before
        within = {k: np.cov(v.T, bias=True) for k, v in x.items()}
        pooled = sum(len(x[k]) * within[k] for k in x) / sum(map(len, x.values()))
        deviation = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        for k in (0, 1):
            assert m.mean[k] == pytest.approx(x[k].mean(0), abs=1e-9)
            cov = (0.8 * within[k] + 0.2 * pooled) / np.outer(deviation, deviation)
            cov = 0.98 * cov + 0.02 * np.trace(cov) / Q.D * np.eye(Q.D)
            assert m.log_det[k] == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-5)
            scaled = m.inverse[k] * deviation
            assert scaled.T @ scaled == pytest.approx(np.linalg.inv(cov), abs=1e-3, rel=1e-4)
        assert m.log_odds == pytest.approx(math.log(len(x[1]) / len(x[0])))


def test_quality_on_awkward_rows(spark, docs, no_docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    rows = Q.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert Q.quality(no_docs, labels).count() == 0
    assert {r["score"] for r in Q.quality(docs, labels.limit(0)).collect()} == {0.5}
    one = Q.quality(docs, labels.filter("quality = 1"))
    assert one.count() == docs.count()


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = Q.op1_qda_quality(spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
    assert (r["predicted"] == r["quality"]).mean() > 0.95


def ctw_by_definition(texts: list[bytes], depth: int) -> dict:
    """Byte code lengths of a full tree: every context, estimates by the product formula, one node at a time."""
    counts: dict[bytes, Counter] = {}
    for t in texts:
        data = b"\xff" * depth + t.lower() + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                counts.setdefault(data[i - d : i], Counter())[data[i]] += 1

    def kt(a: int, b: int) -> float:
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def split(c: Counter, prefix: int, bits: int) -> tuple[int, int]:
        of = [n for byte, n in c.items() if byte >> (8 - bits) == prefix] if bits else list(c.values())
        ones = sum(n for byte, n in c.items() if (byte >> (8 - bits) == prefix or not bits) and byte >> (7 - bits) & 1)
        return sum(of) - ones, ones

    cache: dict = {}

    def weighted(ctx: bytes, prefix: int, bits: int) -> float:
        key = (ctx, prefix, bits)
        if key not in cache:
            a, b = split(counts[ctx], prefix, bits)
            below = [c for c in counts if len(c) == len(ctx) + 1 and c[1:] == ctx]
            e = kt(a, b)
            cache[key] = e if not below else np.logaddexp(e, sum(weighted(c, prefix, bits) for c in below)) - math.log(2)
        return cache[key]

    def one(ctx: bytes, byte_context: bytes, prefix: int, bits: int) -> float:
        a, b = split(counts[ctx], prefix, bits)
        p = (b + 0.5) / (a + b + 1)
        if not any(len(c) == len(ctx) + 1 and c[1:] == ctx for c in counts):
            return p
        deeper = byte_context[len(byte_context) - len(ctx) - 1 :]
        q = one(deeper, byte_context, prefix, bits) if deeper in counts else 0.5
        stop = math.exp(kt(a, b) - weighted(ctx, prefix, bits) - math.log(2))
        return stop * p + (1 - stop) * q

    out = {}
    for ctx in [c for c in counts if len(c) == depth]:
        for byte in range(256):
            bits = 0.0
            for k in range(8):
                p = one(b"", ctx, byte >> (8 - k), k)
                bits -= math.log2(p if byte >> (7 - k) & 1 else 1 - p)
            out[ctx, byte] = bits
    return out


def rows_of(texts: list[bytes], depth: int) -> pd.DataFrame:
    keys, n = C.string_counts(texts, depth)
    tally: Counter = Counter()
    for k, c in zip(keys.tolist(), n.tolist(), strict=True):
        for d in range(depth + 1):
            tally[d, (k >> 8) & ((1 << 8 * d) - 1), k & 255] += c
    return pd.DataFrame([(*k, c) for k, c in tally.items()], columns=["d", "context", "byte", "n"])


def test_tree_weighting_matches_its_definition():
    texts = [b"abab", b"abc", b""]
    depth = 2
    tree = C.grow(rows_of(texts, depth), depth)
    wanted = ctw_by_definition(texts, depth)
    for (ctx, byte), bits in wanted.items():
        node = tree.child[0, tree.symbol[ctx[-1]]]
        for b in ctx[-2::-1]:
            if node < 0:
                break
            node = tree.child[node, tree.symbol[b]]
        assert node < 0
        found = tree.lengths[~node, tree.symbol[byte]] / C.STEPS
        assert bits <= found and (found <= bits + 1.1 / C.STEPS or byte not in b'abc\xff')


def test_tree_is_a_code_and_may_be_cut():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abcde "), 300).tolist()) for _ in range(20)]
    rows = rows_of(texts, 4)
    total = rows.groupby(["d", "context"])["n"].transform("sum")
    for least in (0, 5, 60, 10**9):
        tree = C.grow(rows[(total >= least) | (rows["d"] == 0)], 4)
        assert (np.exp2(-tree.lengths.astype(float) / C.STEPS).sum(1) <= 1 + 1e-9).all()
        assert tree.bits(texts).sum() < 8 * sum(len(t) + 1 for t in texts)
    assert tree.bits([]).size == 0 and C.grow(rows[:0], 4).bits([b""])[0] == pytest.approx(8, abs=0.02)


def test_scores_on_awkward_rows(docs, no_docs):
    out = C.score(docs, depth=3).collect()
    train = [r["text"] or "" for r in docs.collect() if zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t.encode().lower().split())
    n = sum(c.values()) + len(train)
    scale = math.log10(n + len(c) + 2)
    texts = Counter()
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        base = sum(math.log10(c[x] + 1) for x in w) + math.log10(len(train) + 1) - (len(w) + 1) * scale
        texts[r["doc_id"], len(w) + 1, sum(c[x] > 0 for x in w) + 1, round(base, 6)] += 1
    assert texts == Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out)
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 for r in out)
    assert C.score(no_docs, depth=3).count() == 0


def test_scores_match_the_definition(spark):
    """The score of a whole text through Spark, against sums over the tree as it is defined."""
    rng = np.random.default_rng(8)
    texts = [bytes(rng.choice(list(b"abc "), int(rng.integers(0, 40))).tolist()).decode() for _ in range(12)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:12]
    depth = 2
    bits = ctw_by_definition([t.encode() for t in texts], depth)
    out = {r["doc_id"]: r["score"] for r in C.score(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), depth=depth, least=1).collect()}
    for i, t in zip(ids, texts, strict=True):
        data = bytes([C.END] * depth) + t.encode() + bytes([C.END])
        wanted = sum(bits[data[k - depth : k], data[k]] for k in range(depth, len(data)))
        found = -out[i] / math.log10(2)
        assert wanted - 1e-6 <= found <= wanted + 1.1 / C.STEPS * (len(t) + 1)


def test_cold_words_are_joined(docs, monkeypatch):
    a = {(r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in C.score(docs, depth=2).collect()}
    monkeypatch.setattr(C, "HOT_WORDS", 1)
    assert a == {(r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in C.score(docs, depth=2).collect()}


def test_trie_counts_match_whole_segmentations(docs, no_docs):
    model = T.Unigram(T.default_vocabulary())

    def best(word: str) -> tuple[float, int]:
        held = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            options = [(held[i - 1][0] + model.byte * size, -held[i - 1][1] - size)]
            options += [(held[k][0] + model.scores[word[k:i]], -held[k][1] - 1) for k in range(i) if word[k:i] in model.scores]
            s, n = max(options)
            held.append((s, -n))
        return held[-1]

    for r in T.token_counts(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        found = [best("▁" + w) for w in words[:400]] if len(words) <= 400 else None
        assert r["n_pretokens"] == len(words)
        if found is not None:
            assert r["n_tokens"] == sum(n for _, n in found) and r["log_score"] == pytest.approx(sum(s for s, _ in found))
    assert T.token_counts(docs).count() == docs.count() and T.token_counts(no_docs).count() == 0


def test_parts_are_the_whole_tree(spark):
    """Every context that occurs often enough counts, whatever their number; the tree in parts scores as one in memory."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdeé "), 200)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    train = [t.encode() for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    for depth in (1, 2, 3, 4):
        rows = rows_of(train, depth)
        total = rows.groupby(["d", "context"])["n"].transform("sum")
        tree = C.grow(rows[(total >= 3) | (rows["d"] == 0)], depth)
        wanted = dict(enumerate((-tree.bits([t.encode() for t in texts]) * math.log10(2)).tolist()))
        for r in C.score(docs, depth=depth, least=3).collect():
            assert r["score"] == pytest.approx(wanted[r["doc_id"]], abs=0.05)


def test_contexts_of_one_ending_are_dealt_to_many_parts():
    """The last three bytes decide: a third that varies spreads what ends in the same two."""
    keys = np.array([(x << 24) | (ord("e") << 16) | (ord(" ") << 8) | ord("t") for x in range(256)], np.int64)
    assert len(np.unique(C.part_of(keys, 7, 16))) == 16
    same = (np.arange(5000, dtype=np.int64) << 32) | (ord("h") << 24) | (ord("e") << 16) | (ord(" ") << 8) | ord("t")
    assert len(np.unique(C.part_of(same, 7, 16))) == 1
