from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from helixframe.llm import column_bwt as B
from helixframe.llm import minhash_join as M


def gram_set(text, n=5):
    w = (text or "").encode().lower().split()
    n = min(n, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def expected(rows, threshold=0.8):
    """class and links of each row, from all pairs."""
    sets = [gram_set(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(j)
            label[max(x, y)] = min(x, y)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return [(d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("tile", [2048, 3])
def test_join_matches_all_pairs(plain_docs, tile):
    """Also with tiles of three texts, so that groups are split and joined again."""
    rows = [(r["doc_id"], r["text"]) for r in plain_docs.collect()]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in M.near_duplicates(plain_docs, tile=tile).collect())
    assert got == sorted(expected(rows))


def test_join_on_awkward_rows(docs, no_docs):
    out = M.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    assert all(r["class_id"] is None and r["n_links"] == 0 for r in out if r["doc_id"] is None)
    assert M.near_duplicates(no_docs).count() == 0


def test_rows_that_repeat_an_id_are_texts_of_their_own(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long), (5, "zzz other words"), (7, long + " tail"), (7, "zzz other words"), (8, "alone"), (5, long)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(expected(rows))


def test_bands_meet_the_recall():
    for t in (0.5, 0.8, 0.95):
        bands, rows = M.choose_bands(t, 0.99)
        assert 1 - (1 - t**rows) ** bands >= 0.99 or rows == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 99), (99, 98), (200, 200)]
    got = {r["node"]: r["label"] for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 98: 98, 99: 98, 100: 98}


def removed(texts: list[bytes], length: int) -> list[tuple]:
    count = defaultdict(int)
    for t in texts:
        for s in range(len(t) - length + 1):
            count[t[s : s + length]] += 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shared_passages(texts: list[bytes], length: int, words: int) -> list[bool]:
    """Whether a string of length bytes, or of a run of so many words, starts anywhere else."""
    found, sizes = [], set()
    runs = []
    for t in texts:
        edges = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        own = [(edges[k][0], edges[k + words - 1][1]) for k in range(len(edges) - words + 1)]
        runs.append([t[a:b] for a, b in own if b - a < length] + [t[s : s + length] for s in range(len(t) - length + 1)])
        sizes |= {len(x) for x in runs[-1]}
    count = defaultdict(int)
    for size in sizes:
        wanted = {x for r in runs for x in r if len(x) == size}
        for t in texts:
            for s in range(len(t) - size + 1):
                if t[s : s + size] in wanted:
                    count[t[s : s + size]] += 1
    for own in runs:
        found.append(any(count[x] > 1 for x in own))
    return found


@pytest.mark.parametrize(("length", "gram", "words", "most"), [(400, 64, 51, 1024), (40, 16, 9, 1024), (40, 16, 9, 1)])
def test_repeats_match_brute_force(docs, length, gram, words, most):
    """Also with groups of one stretch at most, so that all are split down to single windows."""
    rows = docs.filter("text is null or length(text) < 9000").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    whole = shared_passages(texts, length, words)
    wanted = [(r["doc_id"], *x, y) for r, x, y in zip(rows, removed(texts, length), whole, strict=True)]
    found = B.remove_repeats(docs.filter("text is null or length(text) < 9000"), length=length, gram=gram, words=words, most=most)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["repeats_passage"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert not docs.sparkSession.sql("SHOW TABLES").filter("tableName like 'stretches%'").count()


def test_rows_alike_are_dealt_to_several_buckets(spark, docs, monkeypatch):
    """Rows that repeat in id and text, and the buckets of their texts; results as by brute force."""
    monkeypatch.setattr(B, "REPEATED", 4)
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("length(text) < 3000").collect()]
    rows += [(77, "copied " + "many times over, " * 20)] * 50 + [(78, rows[9][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = []
    made = type(frame).repartition
    monkeypatch.setattr(type(frame), "repartition", lambda self, *a: dealt.append(a) or made(self, *a))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in B.remove_repeats(frame, length=40, gram=16, words=9).collect()]
    wanted = [(r[0], *x) for r, x in zip(rows, removed([(t or "").encode() for _, t in rows], 40), strict=True)]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert any("way" in a for a in dealt)


def test_repeats_of_none(no_docs):
    assert B.remove_repeats(no_docs).count() == 0


def test_long_texts_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 5000, dtype=np.uint8).tobytes()
    whole = {(f, a) for f, _, _, a, _, _ in B.anchors(text, 60, 16)}
    monkeypatch.setattr(B, "SLICE", 700)
    parts = B.anchors(text, 60, 16)
    assert {(f, a) for f, _, _, a, _, _ in parts} == whole
    assert sorted(w for _, a, b, _, _, _ in parts for w in range(a, b - 59)) == list(range(len(text) - 59))


def test_anchors_of_texts_together(docs):
    texts = [(r["text"] or "").encode() for r in docs.select("text").collect()]
    for length, gram, words in ((400, 64, 51), (40, 16, 9)):
        alone = [(k, *x) for k, t in enumerate(texts) for x in B.anchors(t, length, gram, words)]
        assert list(zip(*(c.tolist() for c in B.anchors_of(texts, length, gram, words)), strict=True)) == alone
    assert len(B.anchors_of([b"", b"short"])[0]) == 0


def test_word_runs_pick_their_least_gram():
    rng = np.random.default_rng(5)
    text = bytes(rng.choice(np.frombuffer(b"abcde    \n", np.uint8), 3000))
    data = np.frombuffer(text, np.uint8)
    starts, sizes = B.word_windows(data, 12, 60)
    edges = [m.span() for m in re.finditer(rb"\S+", text)]
    brute = [(edges[k][0], edges[k + 11][1] - edges[k][0]) for k in range(len(edges) - 11)]
    assert list(zip(starts.tolist(), sizes.tolist(), strict=True)) == [x for x in brute if x[1] < 60]
    key = rng.integers(0, 2**60, len(data), dtype=np.uint64)
    assert B.range_least(key, starts, sizes).tolist() == [int(key[s : s + n].min()) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def test_column_order_against_sorting():
    """Windows marked in groups, against comparing all windows of one distance from the anchor."""
    rng = np.random.default_rng(9)
    length = 12
    stretches, groups, rel = [], [], []
    for g in range(6):
        core = rng.integers(97, 99, 30, dtype=np.uint8)
        for _ in range(rng.integers(2, 7)):
            s = core.copy()
            s[rng.integers(0, 30, 2)] = rng.integers(97, 101, 2)
            cut = int(rng.integers(0, 6))
            stretches.append(s[cut : int(rng.integers(26, 31))].tobytes())
            groups.append(g)
            rel.append(10 - cut)
    size = np.array([len(s) for s in stretches])
    found, _ = B.repeated_windows(np.array(groups), np.frombuffer(b"".join(stretches), np.uint8), np.cumsum(size) - size, size, np.array(rel), length)
    for k, s in enumerate(stretches):
        for off in range(rel[k] + 1):
            w = s[rel[k] - off :][:length]
            same = len(w) == length and any(j != k and groups[j] == groups[k] and rel[j] >= off and stretches[j][rel[j] - off :][:length] == w for j in range(len(stretches)))
            assert found[k, off] == same


def copies_of(n, words, seed, edits=1):
    import random

    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "edits"), [(300, 1), (120, 1), (150, 2), (60, 1)])
def test_links_of_many_near_copies(spark, words, edits):
    """Cores, texts outside them, and both beside each other, with tiles of twenty texts: links equal those of all pairs."""
    texts = copies_of(150, words, words, edits) + copies_of(30, words, words, 4 * edits) + copies_of(40, 2 * words, 7)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in M.near_duplicates(frame, tile=20).collect())
    assert got == sorted(expected(rows))
