"""The command line: compress, decompress, extract, check and rmsd.

    python -m helixframe compress [options] INPUT [OUTPUT]

An input is a file, a folder, an archive, a database of plain files, or with -f a
list of these. Tasks write what they have made themselves, so inputs and outputs
must be on storage that the driver and all executors mount.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.strings import base_name, without_extension
from .operators.entry_codec import INTERVAL
from .plans import structures as A
from .sources import keyed_db as K
from .sources import structures as S
from .sources.shared import materialise, write_files, write_text

VERSION = "1.0"
ARCHIVES = (".tar", ".tar.gz", ".tgz")
#: Errors that are printed; all are counted.
SHOWN = 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe", description=__doc__.splitlines()[0])
    p.add_argument("verb", choices=["compress", "decompress", "extract", "check", "rmsd"])
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("-v", "--version", action="version", version=f"helixframe {VERSION}")
    p.add_argument("-t", "--threads", type=int, default=1, help="cores of a session within this machine")
    p.add_argument("-r", "--recursive", action="store_true", help="look for files in folders within the folder")
    p.add_argument("-f", "--file", action="store_true", help="the input is a list of inputs")
    p.add_argument("-a", "--alt", action="store_true", help="the alternative order of atoms")
    p.add_argument("-b", "--break", dest="interval", type=int, default=INTERVAL, help="residues between stored coordinates")
    p.add_argument("-z", "--tar", action="store_true", help="one archive as output")
    p.add_argument("-d", "--db", action="store_true", help="a database as output")
    p.add_argument("-y", "--overwrite", action="store_true")
    p.add_argument("-l", "--id-list", help="a file of ids, for a database as input")
    p.add_argument("-m", "--id-mode", type=int, choices=[0, 1], default=1, help="ids are 0: keys, 1: names")
    p.add_argument("--skip-discontinuous", action="store_true", help="leave out chains with gaps in their numbering")
    p.add_argument("--check", action="store_true", help="decompress only entries that pass a check")
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("--plddt", dest="sequences", action="store_false", help="extract the confidence of each residue")
    kind.add_argument("--fasta", "--amino-acid", dest="sequences", action="store_true", help="extract the sequence")
    p.set_defaults(sequences=False)
    p.add_argument("-p", "--plddt-digits", type=int, choices=[1, 2, 3, 4], default=1)
    p.add_argument("--no-merge", action="store_true", help="a file for each entry that is extracted")
    p.add_argument("--use-title", action="store_true", help="head what is extracted by titles")
    p.add_argument("--time", action="store_true", help="print the seconds taken")
    p.add_argument("--use-cache", action="store_true", help="keep the index of a database as a bucketed table of the session")
    return p


def inputs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """entry, name, content."""
    if a.file:
        held = S.file_list(spark, a.input, a.recursive)
    elif K.is_native(a.input):
        ids = None
        if a.id_list:
            with open(a.id_list) as lines:
                ids = [x.strip() for x in lines if x.strip()]
            ids = [int(i) for i in ids if i.isdigit()] if a.id_mode == 0 else ids
        held = K.read_native(spark, a.input, ids, by_key=a.id_mode == 0, cached=a.use_cache)
        number = F.concat(F.col("key").cast("string"), F.lit("."), F.col("ord").cast("string")) if ids else F.col("key").cast("string")
        held = held.withColumn("entry", F.concat(F.lit(f"{a.input}#"), number))
    else:
        held = S.entries(spark, a.input, a.recursive)
    return held.select("entry", "name", "content")


def _suffix(a: argparse.Namespace) -> str:
    if a.verb == "compress":
        return "fcz"
    if a.verb == "decompress":
        return "pdb"
    return "fasta" if a.sequences else ("plddt" if a.plddt_digits == 1 else "plddt.tsv")


def _plan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """name (without ending), content and error of each output."""
    given = inputs(spark, a)
    if a.verb == "compress":
        out = A.compress_texts(given, a.interval, a.skip_discontinuous, titled=True)
        return out.select(F.regexp_replace("name", r"\.fcz$", "").alias("name"), F.col("blob").alias("content"), "error")
    named = given.select(without_extension(base_name(F.col("name"))).alias("name"), F.col("content").alias("blob"))
    if a.verb == "decompress":
        out = A.decompress_texts(named, a.alt, a.check, titles=True)
        return out.select("name", F.encode("text", "UTF-8").alias("content"), "error")
    out = A.extract_records(named, a.sequences, a.plddt_digits, a.use_title)
    return out.select("name", F.encode("record", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error"))


def _write(plan: DataFrame, a: argparse.Namespace, target: str, one: bool, say: Callable[[str], None]) -> int:
    """Writes what has been made; the number of errors."""
    plan, seen = A.observed(plan, a.verb, "content")
    plan = materialise(plan, a.verb)
    if a.time:
        for what, value in seen.get.items():
            print(f"{a.verb} {what}\t{value}")
    good, suffix = plan.filter("error is null and content is not null"), _suffix(a)
    failed = plan.filter("error is not null").select("name", "error")
    if a.db:
        K.write_native(good, target, overwrite=a.overwrite, ended=a.verb != "compress")
    elif a.tar or target.endswith(".tar"):
        S.write_archive(good.withColumn("name", F.concat("name", F.lit(f".{suffix}"))), target, overwrite=a.overwrite)
    elif a.verb == "extract" and not a.no_merge:
        write_text(good, ["name"], target.rstrip("/"), "content", a.overwrite)
    elif one and good.count() == 1:
        write_text(good, ["name"], target, "content", a.overwrite)
    else:
        folder = os.path.dirname(target) or "." if one else target  # several chains of one file lie beside each other
        done = write_files(good.withColumn("name", F.concat("name", F.lit(f".{suffix}"))), folder, overwrite=a.overwrite)
        failed = failed.unionByName(done.filter("error is not null"))
    count = failed.count()
    for r in failed.limit(SHOWN).collect():
        say(f"{r['name']}: {r['error']}")
    if count > SHOWN:
        say(f"and {count - SHOWN} more errors")
    return count


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code. Texts go to standard output, errors to standard error."""
    a = parser().parse_args(argv)
    began = time.perf_counter()

    def say(text: str) -> None:
        print(text, file=sys.stderr)

    for path in [a.input, *([a.output] if a.verb == "rmsd" and a.output else [])]:
        if not os.path.exists(path) and not K.is_native(path):
            say(f"{path} does not exist")
            return 1
    spark = spark or SparkSession.builder.master(f"local[{max(1, a.threads)}]").appName("helixframe").config("spark.ui.enabled", "false").getOrCreate()
    a.input = a.input.rstrip("/") or "/"
    code = 0
    if a.verb == "rmsd":
        if not a.output:
            say("rmsd takes two structures")
            return 1
        sides = [materialise(S.atoms(S.entries(spark, x).select("entry", "name", "content")).withColumn("entry", F.lit("x")), "side") for x in (a.input, a.output)]
        r = A.compare(*sides).first()
        if r is None or r["error"]:
            say(r["error"] if r else "no atoms")
            return 1
        print("\t".join(map(str, (a.input, a.output, r["n_residue"], r["n_atom"], f"{r['backbone_rmsd']:.6g}", f"{r['all_rmsd']:.6g}"))))
    elif a.verb == "check":
        named = inputs(spark, a).select("name", F.col("content").alias("blob"))
        for r in A.check_entries(named).toLocalIterator():
            print(f"{r['name']} {r['message']}")
            code = code or int(r["outcome"] != "SUCCESS")
    else:
        one = not a.file and os.path.isfile(a.input) and not a.input.endswith(ARCHIVES) and not K.is_native(a.input)
        target = S.output_target(a.input, a.output, _suffix(a), not one and not (a.verb == "extract" and not a.no_merge), a.tar, a.db)
        try:
            code = int(_write(_plan(spark, a), a, target, one, say) > 0)
        except FileExistsError as e:
            say(f"{e} exists already")
            code = 1
    if a.time:
        print(f"{a.verb}\t{time.perf_counter() - began:.3f}")
    return code


def main() -> None:
    sys.exit(run())
