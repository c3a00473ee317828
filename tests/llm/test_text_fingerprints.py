"""Fingerprints against signatures worked out shingle by shingle, and their estimates against Jaccard similarities."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from helixframe.llm import text_fingerprints as T


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    n = min(n, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def signature(text):
    """The least value of each permutation over a set of shingles, one shingle at a time."""
    signer, mask = T.Signer(), (1 << 64) - 1
    values = set()
    for s in shingle_set(text):
        h = 0
        for w in s:
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(w)) & mask
            h ^= h >> 29
        values.add((h * 0xBF58476D1CE4E5B9 & mask) >> 32)
    if not values:
        return None
    return np.array([min((v * a + b) & 0xFFFFFFFF for v in values) for a, b in zip(signer.a.tolist(), signer.b.tolist(), strict=True)], np.uint32)


def expected(rows):
    """Sorted digests of beside_next's rows, by plain Python."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)))))
    out = []
    for k, (d, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        marks = [T.Signer.fingerprint(signature(x)) for x in (t, edited, following)]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], T.likeness(marks[0], marks[1]), T.likeness(marks[0], marks[2])))
    return sorted(out, key=repr)


def taken(frame):
    return sorted(((*tuple(r)[:3], bytes(r[3]), bytes(r[4]), *tuple(r)[5:]) for r in frame.collect()), key=repr)


def test_equals_signatures_shingle_by_shingle(spark, docs, no_docs):
    rows = [(r["doc_id"], None if r["text"] is None else r["text"][:900]) for r in docs.collect()]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fingerprint string, place int").repartition(3)
    assert taken(T.beside_next(frame)) == expected(rows)
    assert T.beside_next(no_docs).count() == 0


@pytest.mark.parametrize("rows", [[(1, "alone with a few words here")], [(None, None)], [(1, "a b"), (1, "a b"), (1, "a b")], [(2, "x" * 9), (1, "")]])
def test_few_rows(spark, rows):
    assert taken(T.beside_next(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


@pytest.mark.parametrize("seed", range(12))
def test_heads_and_ends_make_whole_texts(seed):
    """Cut anywhere, also within words and in white space, a text has the signature of its whole."""
    rng = random.Random(seed)
    signer = T.Signer()
    for _ in range(40):
        text = "".join(rng.choice("ab é\n 😀") for _ in range(rng.randrange(60)))
        end = "".join(rng.choice("ab é\n ") for _ in range(rng.randrange(40)))
        head = signer.begun(text)
        got, want = signer.ended(head, end), signature(text[: len(text) - len(text) // 4] + end)
        assert (got is None and want is None) or (got == want).all()


def test_likeness_estimates_the_jaccard_similarity():
    rng = random.Random(1)
    signer, errors = T.Signer(), []
    for _ in range(150):
        words = [str(rng.randrange(10_000)) for _ in range(300)]
        cut = rng.randrange(300)
        a, b = " ".join(words), " ".join(words[:cut] + [str(rng.randrange(10_000)) for _ in range(300 - cut)])
        errors.append(T.likeness(signer.fingerprint(signer.signature(a)), signer.fingerprint(signer.signature(b))) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.05


def test_the_same_text_alone_has_the_same_fingerprint(docs):
    alone = {(r["doc_id"], r["n_chars"], bytes(r["fingerprint"])) for r in T.fingerprints(docs).collect()}
    beside = {(r["doc_id"], r["n_chars"], bytes(r["fingerprint"])) for r in T.beside_next(docs).collect()}
    assert alone == beside


def test_texts_that_share_a_band_are_verified(spark, plain_docs):
    """Classes and links equal those of all pairs, compared on their shingle sets."""
    from test_pairs_and_repeats import expected as all_pairs

    rows = [(r["doc_id"], r["text"]) for r in plain_docs.collect()]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in T.similar(plain_docs).collect())
    assert got == sorted(all_pairs(rows))


def test_signatures_of_sets_and_of_texts_are_the_same():
    from helixframe.llm.minhash_join import ngrams

    signer = T.Signer()
    for text in ("a b c d e f g a b c d e", "x", "One two THREE four five six"):
        assert (signer.minima((ngrams(text.encode(), 5, {}) >> np.uint64(32)).astype(np.uint32)) == signer.signature(text)).all()
