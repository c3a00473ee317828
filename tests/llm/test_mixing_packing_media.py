from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import nnls_packing as N
from helixframe.llm import progressive_jpeg as J
from helixframe.llm import temperature_mixing as T


def plain_mix(tokens, repeats=None, target_entropy=None, budget=None):
    """power, weights and passes, from a scan of powers in place of a bisection."""
    tokens = np.array(tokens, float)
    full = tokens > 0
    shares = tokens[full] / tokens.sum()

    def at(power):
        w = shares**power / (shares**power).sum()
        total = budget if budget is not None else (tokens[full] / w).max()
        return w, w * total / tokens[full]

    for power in np.linspace(0, 1, 20001):
        w, p = at(power)
        if (p.max() <= repeats + 1e-9) if repeats is not None else (-(w * np.log(w)).sum() <= target_entropy):
            break
    weights, passes = np.zeros(len(tokens)), np.ones(len(tokens))
    weights[full], passes[full] = w, p
    return power, weights, passes


def test_bisected_power_meets_its_targets(spark):
    tokens = np.array([1000.0, 100, 10])
    sums = T.local_sums(tokens, np.ones(3))
    m = T.solve(sums, 10, 1000, 1110, repeats=3.0)
    passes = (tokens / 1110) ** m.power / m.norm * m.total / tokens
    assert passes.max() == pytest.approx(3.0, rel=1e-6) and passes.min() == pytest.approx(1.0)
    assert m.power == pytest.approx(plain_mix(tokens, 3.0)[0], abs=1e-4)
    e = T.solve(sums, 10, 1000, 1110, repeats=None, target_entropy=0.8)
    assert T.entropy((tokens / 1110) ** e.power / e.norm) == pytest.approx(0.8, abs=1e-6)
    assert T.solve(T.local_sums(np.array([5.0]), np.array([2])), 5, 5, 10, repeats=1.0).power == 0.0
    b = T.solve(sums, 10, 1000, 1110, repeats=None, target_entropy=0.8, budget=500)
    assert b.total == 500
    held = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("d", 0)], "source string, tokens long")
    plans = [{r["source"]: tuple(r) for r in T.planned(held, 3.0, None, None, local).collect()} for local in (0, 10)]
    assert plans[0]["d"] == plans[1]["d"] == ("d", 0.0, 1, 0)
    for k in "abc":
        assert plans[0][k] == pytest.approx(plans[1][k]) if not isinstance(plans[0][k][0], str) else plans[0][k][1:] == pytest.approx(plans[1][k][1:])


def plain_rows(rows, blocks, seed, plan):
    """The rows that a mix takes, from the definition: (source, epoch, record), with the keys that the rows carry."""
    out = []
    for source, (epochs, left) in plan.items():
        own = [r for r in rows if r["source"] == source]
        for e in range(epochs):
            out += [(source, e, r["record"]) for r in own]
        # The last pass: block by block and row by row in the order of their keys, until the budget is reached; equal keys go together.
        order = sorted({(r["keys"][epochs]) for r in own})
        used = 0
        for key in order:
            if used >= left:
                break
            some = [r for r in own if r["keys"][epochs] == key]
            used += sum(r["tokens"] for r in some)
            out += [(source, epochs, r["record"]) for r in some]
    return out


@pytest.mark.parametrize("budget", [None, 900])
def test_mixed_rows(docs, budget):
    """Row for row, against the definition."""
    repeats, target, blocks = (None if budget else 2.5), (1.0 if budget else None), 4
    got = T.mix(docs, blocks=blocks, budget=budget, repeats=repeats, target_entropy=target).collect()
    x = docs.select(F.struct(*docs.columns).alias("record"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("doc_id", "text").alias("key"))
    x = x.withColumn("block", F.pmod(F.xxhash64(F.lit(T.SEED), "key"), F.lit(blocks).cast("long")))
    keys = F.array(*[F.struct(F.xxhash64(F.lit(T.SEED), F.lit(e), "source", "block").alias("b"), F.xxhash64(F.lit(T.SEED), F.lit(e), "key").alias("d")) for e in range(12)])
    given = [r.asDict() | {"tokens": len((r["record"]["text"] or "").encode().split())} for r in x.withColumn("keys", keys).collect()]
    total = defaultdict(int)
    for r in given:
        total[r["source"]] += r["tokens"]
    names = sorted(total)
    _, weights, passes = plain_mix([total[n] for n in names], repeats, target, budget)
    taken = {r["source"]: r["weight"] for r in got}
    assert all(taken[n] == pytest.approx(w, abs=1e-3) for n, w in zip(names, weights, strict=True) if n in taken)
    # The scan of powers is coarse, so tokens of the last pass may differ by a few; the rows' own plan decides.
    plan = {r["source"]: (r["epochs"], r["left"]) for r in T.planned(docs.sparkSession.createDataFrame([(n, total[n]) for n in names], "source string, tokens long"), repeats, target, budget).collect()}
    for n, p in zip(names, passes, strict=True):
        assert plan[n][0] + plan[n][1] / max(total[n], 1) == pytest.approx(p, abs=2e-2)
    wanted = plain_rows(given, blocks, T.SEED, plan)
    assert sorted((r["source"], r["epoch"], repr(tuple(r["record"]))) for r in got) == sorted((s, e, repr(tuple(r))) for s, e, r in wanted)
    if not budget:
        assert {tuple(r["record"]) for r in got} == {tuple(r["record"]) for r in given}


def test_mix_in_order(plain_docs):
    mixed = T.mix(plain_docs)
    wanted = [tuple(r["record"]) for r in mixed.orderBy("epoch", "block_key", "doc_key").collect()]
    assert [tuple(r) for r in T.in_order(mixed).collect()] == wanted


def test_mix_of_none(no_docs):
    assert T.mix(no_docs).count() == 0


def test_nnls_conditions():
    rng = np.random.default_rng(2)
    a, b = rng.random((15, 40)), rng.normal(size=15)
    x = N.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert x.min() >= 0 and g.max() < 1e-8 and abs(g[x > 0]).max(initial=0) < 1e-8


def test_combinations_fill_the_window():
    found = N.combinations(12, 3)
    brute = {tuple(sorted((a, b, c), reverse=True)) for a in range(13) for b in range(13) for c in range(13) if a + b + c == 12}
    assert {tuple(c) for c in found} == {tuple(x for x in c if x) for c in brute} and len(set(found)) == len(found)


def test_plan_stays_within_the_histogram():
    h = np.zeros(64, np.int64)
    h[[63, 31, 15, 47, 4, 58]] = [10, 21, 40, 13, 9, 8]
    used = np.zeros(64, np.int64)
    for c, n in N.plan_combinations(h):
        assert sum(c) == 64
        for b in c:
            used[b - 1] += n
    assert (used <= h).all() and used.sum() > 0 and N.plan_combinations(np.zeros(64, np.int64)) == []


def test_word_ids_are_the_tokenizers(docs):
    words = N.WordIds(N.default_tokenizer())
    for r in docs.collect():
        t = r["text"] or ""
        assert np.frombuffer(words.of(t.encode()), words.kind).tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_tokenizer_file():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(N.default_tokenizer())
    words = N.WordIds(N.default_tokenizer())
    for t in ("x <|endoftext|> y", "x<|endoftext|>y, <|startoftext|>!", "<|ENDOFTEXT|> A数<|EndOfText|> é<|endoftext|>É", "plain"):
        assert np.frombuffer(words.of(t.encode()), words.kind).tolist() == fresh.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [4096, 64])
def test_packing_keeps_every_id(docs, window):
    """Every document's ids, as a fresh tokenizer has them, are covered by its pieces once."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(N.default_tokenizer())
    pieces = N.pack(docs, window=window, bins=16).collect()
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    assert 1 - sum(p["length"] for p in pieces) / (window * len(sequences)) < 0.5
    # Rows that repeat an id and a text are alike, so a document's pieces are told by both; each start comes as often as the row does.
    given = Counter((r["doc_id"], tuple(fresh.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)) for r in docs.collect())
    by_id = defaultdict(list)
    for (i, ids), times in given.items():
        by_id[i].append((ids, times))
    for i, known in by_id.items():
        own = Counter((p["start"], p["doc_tokens"], bytes(p["ids"])) for p in pieces if p["doc_id"] == i)
        for ids, times in known:
            whole = np.array(ids, "<u4").tobytes()
            # Walk the document from its first id: every place is covered as often as the row comes.
            cover = np.zeros(len(ids), int)
            for (start, total, held), n in own.items():
                if total == len(ids) and whole[4 * start : 4 * start + len(held)] == held:
                    cover[start : start + len(held) // 4] += n
            assert (cover >= times).all()
        assert sum(len(x[2]) // 4 * n for x, n in own.items()) == sum(len(ids) * times for ids, times in known)
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}


def test_padding_is_small(spark):
    """Over the driver's small table, window by window."""
    pieces = N.digests(N.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    tokens, sequences = pieces.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert 1 - tokens / (4096 * sequences) < 0.02


def test_packing_of_none(no_docs):
    assert N.pack(no_docs).count() == 0


def test_media_round_trip(docs, no_docs):
    seen = {}
    for r in J.media_columns(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = (r["text"] or "").encode()
        if r["n_bytes"] != len(text):
            continue
        payload = J.payload_of(text)
        assert r["payload_bytes"] == len(payload) and len(payload) % 576 == 0 and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_bytes"] == len(r["media"]) and len(r["rgb"]) == r["width"] * r["height"] * 3
        assert seen.setdefault(text, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert J.media_columns(docs).count() == docs.count() and J.media_columns(no_docs).count() == 0


def java(spark):
    jvm = spark._jvm

    def read(data: bytes) -> np.ndarray:
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
        w, h = image.getWidth(), image.getHeight()
        v = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64) & 0xFFFFFF
        return np.stack([v >> 16, v >> 8 & 255, v & 255], -1).reshape(h, w, 3)

    def write(rgb: np.ndarray, quality: float) -> bytes:
        h, w, _ = rgb.shape
        image = jvm.java.awt.image.BufferedImage(w, h, 1)
        for y in range(h):
            for x in range(w):
                image.setRGB(x, y, int(rgb[y, x, 0]) << 16 | int(rgb[y, x, 1]) << 8 | int(rgb[y, x, 2]))
        writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
        p = writer.getDefaultWriteParam()
        p.setProgressiveMode(1)
        p.setCompressionMode(2)
        p.setCompressionQuality(quality)
        out = jvm.java.io.ByteArrayOutputStream()
        stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), p)
        stream.flush()
        return bytes(out.toByteArray())

    return read, write


@pytest.mark.parametrize("quality", [0.4, 0.95])
def test_decoder_agrees_with_another_codec(spark, quality):
    """Streams of another encoder, with scans and refinements of its own choice, beside ours in one batch."""
    read, write = java(spark)
    y, x = np.mgrid[0:37, 0:50]
    rgb = np.stack([x * 5 % 256, (x + y) * 3 % 256, 128 + 60 * np.sin(y / 5)], -1).astype(int)
    data = write(rgb, quality)
    own = J.store([J.payload_of(b"hello")])[0]
    images, coefficients = J.decode([data, own, data])
    samples = J.samples_of(images, coefficients)
    for k in (0, 2):
        mine = J.rgb_tensor(images[k], samples).astype(int)
        assert mine.shape == rgb.shape and np.abs(mine - read(data)).mean() < 6
    assert J.read_back(images[1], coefficients) == J.payload_of(b"hello")


def test_our_streams_are_valid_elsewhere(spark):
    """Grey images, whose chroma has no detail, come out of another decoder as out of ours."""
    read, _ = java(spark)
    rng = np.random.default_rng(4)
    mcus = np.zeros((6, 6, 64), np.int16)
    mcus[:, :4, 0] = rng.integers(-60, 60, (6, 4)) * 8
    mcus[:, :4, 1:20] = rng.integers(-9, 9, (6, 4, 19)) * 2
    mcus[0, 0, 40] = 14
    stream = J.encode([(mcus, 3, 2)])[0]
    images, coefficients = J.decode([stream])
    assert (np.sort(np.unique(coefficients)) == np.sort(np.unique(mcus))).all()
    mine = J.rgb_tensor(images[0], J.samples_of(images, coefficients)).astype(int)
    assert np.abs(mine - read(stream)).max() <= 2


def test_broken_streams():
    with pytest.raises(ValueError):
        J.decode([b"\xff\xd8\x00\x00\x00\x00"])
