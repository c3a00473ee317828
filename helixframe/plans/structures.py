"""Whole plans over structure texts: compress, decompress, extract, compare."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import base_name, confidence_digits
from ..operators import entry_codec as E
from ..operators import lookup as L
from ..operators import report as P
from ..operators import segments as M
from ..sources import structures as S


def fragments(atoms: DataFrame) -> DataFrame:
    """Atom rows with segment (run of a chain, from its first N) and fragment (no gap in numbering at N atoms)."""
    deduped = M.drop_adjacent_repeats(atoms, ["entry", "model"], ["pos"], "atom")
    chains = M.chain_segments(deduped, ["entry", "model"], ["pos"], "chain", F.col("atom") == "N")
    return M.gap_fragments(chains, ["entry", "model", "segment"], ["pos"], "residue_index", F.col("atom") == "N")


def compress_texts(texts: DataFrame, interval: int = E.INTERVAL, skip_discontinuous: bool = False, hetero: bool = False, titled: bool = False, timed: bool = False) -> DataFrame:
    """name (of the output), source (the input's name), entry, blob and error for each chain fragment of texts (name, content and, where names repeat, entry).

    A text without a fragment, be it null, empty, broken or without atoms, gives one
    row with an error. titled: the entry's title is what the text says it is; else, and
    where it says nothing, its file's name. A text that comes twice gives its fragments
    once. timed: also seconds, the fragment's share of what
    encoding its batch took.
    """
    keyed = S._keyed(texts)
    stem = F.regexp_replace(base_name(F.coalesce("name", F.lit(""))), r"\.[^.]*$", "")
    named = S.titles(keyed, contents=True) if titled else keyed.select("entry", "name", "content", F.lit("").alias("title"))
    named = named.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), stem))
    # A text is in one row: its atoms are never rows, which windows would sort again and again. What moves is its entries.
    made = E.encoded_texts(S.record_arrays(named), S.parsed_records, interval, hetero)
    # A number of partitions of one's own: by their bytes, which are few, entries would be dealt to a few tasks, in which all that is made of them runs.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = made.repartition(parts, "entry").groupBy("entry").agg(F.max(F.struct(F.size("made").alias("n"), "name", "made")).alias("_")).select("entry", "_.name", "_.made")
    if skip_discontinuous:
        whole = F.filter("made", lambda f: f["pieces"] == 1)
        none = F.lit(None).cast("binary")
        # Of a text all of whose segments are discontinuous one row stays, to tell it.
        told = F.transform(F.slice("made", 1, 1), lambda f: f.withField("blob", none).withField("error", F.lit("discontinuous")).withField("segments", F.lit(1)).withField("pieces", F.lit(1)))
        made = made.withColumn("made", F.when(F.size(whole) > 0, whole).otherwise(told))
    out = made.select("entry", "name", F.explode_outer("made").alias("f"))
    chain = F.when(F.col("f.segments") > 1, F.coalesce("f.chain", F.lit("None"))).otherwise("")
    part = F.concat(chain, F.when(F.col("f.pieces") > 1, F.concat(F.lit("_"), F.col("f.fragment").cast("string"))).otherwise(""))
    error = F.when(F.col("f").isNull(), "no atoms that can be encoded").otherwise(F.col("f.error"))
    columns = [F.concat(stem, part, F.lit(".fcz")).alias("name"), F.col("name").alias("source"), "entry", F.col("f.blob").alias("blob"), error.alias("error")]
    return out.select(*columns, *([F.coalesce("f.seconds", F.lit(0.0)).alias("seconds")] if timed else []))


def observed(made: DataFrame, stage: str, content: str = "blob") -> tuple[DataFrame, Observation]:
    """made, and what is counted while it is computed: its rows, those with an error, their bytes and, where there are seconds, these and the longest.

    The observation's get waits for the run that computes the rows; a listener sees it under the stage's name.
    """
    seen = Observation(stage)
    counts = [F.count(F.lit(1)).alias("rows"), F.count("error").alias("errors"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("bytes")]
    if "seconds" in made.columns:
        counts += [F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.max("seconds"), F.lit(0.0)).alias("longest")]
    return made.observe(seen, *counts), seen


def decompress_texts(entries: DataFrame, alternate: bool = False, check: bool = False, titles: bool = False) -> DataFrame:
    """entries (name, blob and others) without blob, with PDB text (ATOM records and a TER) and error, one row for each.

    check: entries that fail a check get what is said of it as error, and no text.
    """
    return E.texts(entries, alternate, titles, check)


def extract_plddt(entries: DataFrame, digits: int = 1) -> DataFrame:
    """name, title, n_residue and the confidence of each residue in so many digits; from two digits on they are joined by commas."""
    rows = E.extract(entries)
    unit = F.array_max("temps") <= 1
    each = F.transform("temps", lambda t: confidence_digits(t, digits, unit))
    return rows.select("name", "title", "n_residue", F.array_join(each, "" if digits == 1 else ",").alias("data"))


def extract_fasta(entries: DataFrame, use_title: bool = False) -> DataFrame:
    return E.extract(entries).select("name", P.fasta(F.col("title" if use_title else "name"), F.col("sequence")).alias("record"))


def extract_records(entries: DataFrame, sequences: bool = False, digits: int = 1, use_title: bool = False) -> DataFrame:
    """name and record: what an extraction writes of each entry, headed by its name or title. Bytes that are no entry have none."""
    if sequences:
        return extract_fasta(entries, use_title).filter("record is not null")
    rows = extract_plddt(entries, digits)
    head = F.col("title" if use_title else "name")
    record = P.fasta(head, F.col("data")) if digits == 1 else F.concat(P.tsv(head, F.col("n_residue"), F.col("data")), F.lit("\n"))
    return rows.filter("n_residue is not null").select("name", record.alias("record"))


def check_entries(entries: DataFrame) -> DataFrame:
    """name, outcome and what is said of it."""
    rows = E.extract(entries)
    return rows.select("name", "outcome", F.coalesce(P.validity_message(F.col("outcome")), F.concat(F.lit("is no entry: "), "outcome")).alias("message"))


def compare(a: DataFrame, b: DataFrame, key: str = "entry") -> DataFrame:
    """key, n_residue, n_atom, backbone_rmsd, all_rmsd and error of the structures of one key in two sets of atom rows, by place.

    Structures that do not have as many atoms, those that one set alone has, and, where
    the key is not the entry, keys that several entries share, have an error and no
    distances.
    """
    pairs = L.zip_rows(a, b, [key], ["pos"])
    x, y = F.col("left"), F.col("right")
    squares = sum(((x[k] - y[k]) ** 2 for k in ("y", "z")), (x["x"] - y["x"]) ** 2)
    backbones = tuple(s["atom"].isin("N", "CA", "C") for s in (x, y))
    sides = [s["entry"] for s, df in ((x, a), (y, b)) if "entry" in df.columns and key != "entry"]
    # An entry's rows have one name; two of one name have an entry that is not the least.
    spans = {f"_first{k}": s for k, s in enumerate(sides)} | {f"_least{k}": F.min(s).over(W.partitionBy(key)) for k, s in enumerate(sides)}
    out = P.rmsd_report(pairs, [key], squares, backbones, also=spans)
    several = F.lit(False)
    for k in range(len(sides)):
        several = several | F.coalesce(F.col(f"_first{k}") != F.col(f"_least{k}"), F.lit(False))
    values = [F.when(~several, F.col(c)).alias(c) for c in ("n_residue", "n_atom", "backbone_rmsd", "all_rmsd")]
    return out.select(key, *values, F.when(several, f"several structures of one {key}").otherwise(F.col("error")).alias("error"))


def each_entry(entries: DataFrame, process: Callable[[str, bytes], tuple], schema: str) -> DataFrame:
    """name and what a function of name and bytes returns for each entry (name, content), in columns of a schema."""
    columns = ["name", *(c.split()[0] for c in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(n, *process(n, bytes(c))) for n, c in zip(f["name"], f["content"], strict=True)], columns=columns)

    return entries.select("name", "content").mapInPandas(run, f"name string, {schema}")
