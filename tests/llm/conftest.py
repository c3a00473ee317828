"""A small table of awkward documents, for all operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("row", T.StringType()), T.StructField("record", T.LongType()), T.StructField("bucket", T.StringType())])


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ter", "un", "é", "sch")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls everywhere, empty and long texts, copies, near copies, shared passages, repeated rows and ids."""
    rng = random.Random(5)
    passage = prose(rng, 120)
    base = prose(rng, 200)
    words = base.split()
    texts = [None, "", "", " ", "one", "One", "ONE two", "Éa b C", "éa b c", base, base.upper().replace("É", "É"), base + " tail", " ".join(words[:100] + ["changed"] + words[101:])]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 30) for _ in range(4)]
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(25)]
    texts += ["ab" * 1500, "x" * 900, prose(rng, 6000), "\x00\x01 tab\tand\nlines\r\n" * 3, "数学 😀 words " * 40, "<|endoftext|> it's 12 don't!! ... 'tis"]
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "clash", i, "b") for i, t in enumerate(texts)]
    rows += [rows[9], (None, "no id", "s1", None, None, None), (None, None, None, None, None, None), (9, base, "s0", None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def plain_docs(spark):
    """The same texts, each with an id of its own."""
    return spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(awkward())], "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
