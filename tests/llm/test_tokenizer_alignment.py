"""Alignments and scores against all pairs of tokens, compared byte range by byte range."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from helixframe.llm import tokenizer_alignment as A

ODD = [
    None, "", " ", "a", "one two", " lead", "trail ", "a  b", "a\n b", "a \nb", "a\n \nb", "a  b", "tab\tx y", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁x", "x ▁", "é ﬁ ① 数学 😀 z",
    "it's don't I'll", "　wide", "a b c", "\x00 \x1c y", "Ünïcödé wörds — and… dashes", "x" * 700, "no\nlines here\nnone", "two\n\nlines\n\n\nb", "\nfirst", "last\n", "a \u0301b", "décompose é f",
]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path(A.FIRST))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path(A.SECOND))


def ranges(ids, spelled):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(spelled(i)), i))
        at = out[-1][1]
    return out


def brute(text, models):
    """n_a, n_b, groups and the list of links of one text."""
    first, second = models
    if not text:
        return 0, 0, [], []
    ids_a, ids_b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    letters = {c: b for b in range(256) for c in [A_LETTERS[b]]}
    spell_a = lambda i: bytes(letters[c] for c in first.id_to_token(i)) if all(c in letters for c in first.id_to_token(i)) else first.id_to_token(i).encode()
    spell_b = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    a, b = ranges(ids_a, spell_a), ranges(ids_b, spell_b)
    want = (" " + text).encode()
    if b"".join(map(spell_a, ids_a)) != want or b"".join(map(spell_b, ids_b)) != want:
        return 0, 0, [], []
    cuts = sorted({x[1] for x in a} & {x[1] for x in b})
    groups = [(",".join(str(i) for s, e, i in a if lo <= s and e <= hi), ",".join(str(i) for s, e, i in b if lo <= s and e <= hi)) for lo, hi in zip([0, *cuts], cuts)]
    links = [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]
    return len(a), len(b), groups, links


A_LETTERS = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
A_LETTERS |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in A_LETTERS)}


def expected(texts, models):
    held = [brute(t, models) for t in texts]
    docs = Counter(p for h in held for p in set(h[3]))
    most = Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for n_a, n_b, groups, links in held:
        text = ";".join("|".join(g) for g in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, docs, Counter(p for h in held for p in h[3])


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("chunk_docs", "block"), [(4096, 1 << 20), (16, 64)])
def test_equals_all_pairs_of_tokens(spark, models, docs, monkeypatch, chunk_docs, block):
    """Also with chunks of sixteen documents, so that bitmaps are dense, and with parts of a few bitmaps."""
    texts = ODD + [r["text"] if r["text"] is None else r["text"][:3000] for r in docs.select("text").collect()] + ["same again"] * 40
    rows = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, chunk int").repartition(2)
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    monkeypatch.setattr(A, "CHUNK_DOCS", chunk_docs)
    if chunk_docs != 4096:  # workers see the module as it is on disk, so its parts are run here
        aligner, chunk, batches = A.Aligner(*A.default_paths()), None, []
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(A.CHUNKS))
        for k, found in enumerate(aligner.of(texts)):
            chunk = chunk or A.Chunk(k)
            chunk.add(k, *found)
            if chunk.full() or k == len(texts) - 1:
                batches += [b.to_pylist() for b in chunk.batches(schema)]
                chunk = None
        held = spark.createDataFrame([r for b in batches for r in b], A.CHUNKS)
        counts = A.pair_counts(held)
        parts = [r for b in batches for r in b if r["part"] is not None]
        valued = {r["pair"]: r for r in counts.collect()}
        most = Counter()
        for r in valued.values():
            most[r["a"]] = max(most[r["a"]], r["docs"])
        import pandas as pd

        got = {r["doc_id"]: [r[c] or 0 for c in COLUMNS[:4]] + [0, 0, r["groups_sha256"]] for b in batches for r in b if r["slot"] is not None}
        of = {(r["chunk"], r["slot"]): r["doc_id"] for b in batches for r in b if r["slot"] is not None}
        for number in {r["chunk"] for r in parts}:
            left = pd.DataFrame([{f"_{k}": v for k, v in r.items()} for r in parts if r["chunk"] == number])
            right = pd.DataFrame([(r["part"], i, valued[p]["docs"], valued[p]["docs"] == most[valued[p]["a"]]) for r in parts if r["chunk"] == number for i, p in enumerate(r["pairs"])], columns=["part", "place", "docs", "best"])
            for row in A._sums(left, right).itertuples():
                got[of[(row.chunk, row.slot)]][4:6] = [row.n_best, row.count_sum]
        got = [tuple(got[k]) for k in range(len(texts))]
        assert len(parts) > 3
    else:
        out, counts = A.align(rows)
        got = [tuple(r[c] for c in COLUMNS) for r in sorted(out.collect(), key=lambda r: r["doc_id"])]
    want, docs_of, links_of = expected(texts, models)
    assert got == want
    assert {(r["a"], r["b"]): (r["docs"], r["links"]) for r in counts.collect()} == {p: (docs_of[p], links_of[p]) for p in docs_of}


def test_words_are_tokenised_as_in_whole_texts(models):
    aligner = A.Aligner(*A.default_paths())
    for text in ODD[3:] + ["ab\ncd ef\tgh i", "'s 've x' y", "1234 5 67a ,.;: (x) [y]"]:
        whole = aligner.whole(text)
        by_words = next(aligner.of([text]))
        assert (by_words[:3] if whole else (0, 0, 0)) == by_words[:3] and (whole is None or (whole[:3] == by_words[:3] and whole[4] == by_words[4].tobytes() and hashlib.sha256(whole[3]).hexdigest() == by_words[3]))


def test_bitmaps_come_back_as_they_were():
    rng = np.random.default_rng(3)
    pairs, slots = rng.integers(0, 40, 60_000) ** 2, rng.integers(0, A.CHUNK_DOCS, 60_000)
    pair, plane, slot = A.planes(pairs, slots)
    cards, data = A.squeezed((pair << 5) + plane, slot)
    owner, back = A.opened(cards, b"".join(data))
    order = np.lexsort((back, owner))
    _, place = np.unique((pair << 5) + plane, return_inverse=True)
    assert (back[order] == slot).all() and (owner[order] == place).all()
    times = Counter(zip(pairs.tolist(), slots.tolist(), strict=True))
    again = Counter()
    for p, k, s in zip(pair.tolist(), plane.tolist(), slot.tolist(), strict=True):
        again[(p, s)] += 1 << k
    assert again == times


def test_no_rows(no_docs):
    out, counts = A.align(no_docs)
    assert out.count() == 0 and counts.count() == 0
