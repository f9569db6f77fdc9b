"""Which runs of four characters stand in a file of a log table, so that a search opens only files that may hold a match.

``<path>/_grams/<folder>/places/*.parquet`` holds, per file of a folder, a Bloom filter with one hash function over the ASCII runs
of ``GRAM`` characters in its payloads, without regard to case: one row per bit that is set, so that it grows with the runs of a
file and small files have small ones. A pattern is looked up by the literals that each of its matches must contain; files where a
run of them is missing are left out, and the pattern still decides the rows of the others. `index_grams` builds what is missing; a
folder without it is read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession, Window, functions as F

from ..operators.filters import class_end
from ..schema import LOG_SCHEMA
from .manifest import Folder, TableFiles, latest

GRAM = 4
#: Bits per file, numbered from 1: a file of a million log lines has some 100 000 distinct runs.
BITS = 1 << 20
#: Files up to this number are named to the scan; where more of them may match, their folders are listed and the others dropped.
MOST_NAMED = 100
#: ``file`` is the hash of a file's name; the row of place 0, which every file with rows has, holds the name.
_SCHEMA = "folder string, file bigint, place int, name string"
#: Escapes that stand for a class or a place. Any other letter or digit may carry an argument.
_PLAIN_ESCAPES = set("dDsSwWbBAzZGhHvVRXtnrfae")


def grams_of(name: str) -> str:
    return f"_grams/{name}"


def folded(text: Column) -> Column:
    """ASCII text as a search without regard to case sees it: characters beyond ASCII that it takes for ASCII ones become these."""
    return F.lower(F.upper(F.translate(text, "\u0130\u212a", "ik")))


def _place(gram: Column) -> Column:
    return (F.pmod(F.xxhash64(gram), F.lit(BITS)) + 1).cast("int")


def _file(name: Column) -> Column:
    """Files that share a hash share their runs, so that both are read where one of them may match."""
    return F.xxhash64(name)


def _places_of(name: str) -> str:
    return f"{grams_of(name)}/places"


def index_grams(spark: SparkSession, path: str) -> list[str]:
    """Index the live folders of a table that have no index yet; returns their names. To be run after `compact_in_place`.

    Distinct runs are found by a hash aggregate of fixed-width values, so what is shuffled is bounded by ``BITS`` numbers per
    file and task, whatever the lines repeat. An index goes with its folder.
    """
    files = TableFiles(spark, path)
    new = [f.name for f in latest(files).folders if not _indexed(files, f)]
    for name in new:
        rows = spark.read.schema(LOG_SCHEMA).parquet(f"{files.path}/{name}")
        runs = F.regexp_extract_all(folded(F.col("payload")), F.lit(rf"(?=([\x00-\x7F]{{{GRAM}}}))"), F.lit(1))
        held = F.coalesce(F.transform(runs, _place), F.array().cast("array<int>"))
        file = F.col("_metadata.file_name")
        places = rows.select(
            _file(file).alias("file"), file.alias("name"), F.explode(F.array_union(F.array(F.lit(0)), held)).alias("place")
        ).select("file", "place", F.when(F.col("place") == 0, F.col("name")).alias("name")).distinct()
        index = places.sortWithinPartitions("place").select(F.lit(name).alias("folder"), "file", "place", "name")
        index.write.mode("overwrite").parquet(f"{files.path}/{_places_of(name)}")
    return new


def _indexed(files: TableFiles, folder: Folder) -> bool:
    return files.exists(f"{_places_of(folder.name)}/_SUCCESS")


def required_literals(pattern: str) -> list[list[str]] | None:
    """Alternatives of a checked pattern, each as literals that all of its matches contain; null where one has none.

    Only the outermost level is looked at: a group, a class or a repeated character ends a literal.
    """
    branches, literals, run, i = [], [], "", 0

    def end(keep: int | None = None) -> None:
        nonlocal run
        literals.append(run[:keep])
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            escaped = pattern[i + 1 : i + 2]
            if escaped.isascii() and escaped.isalnum():
                if escaped not in _PLAIN_ESCAPES:
                    return None
                end()
            else:
                run += escaped
            i += 2
            continue
        if c == "[":
            end()
            i = class_end(pattern, i)
            continue
        if c == "(":
            end()
            i = _group_end(pattern, i)
            if i < 0:
                return None
            continue
        if c == "|":
            end()
            branches.append(literals)
            literals = []
        elif c in "?*{":
            end(-1)
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return None
        elif c in "+.^$":
            end()
        else:
            run += c
        i += 1
    end()
    wanted = [[text for text in branch if len(text) >= GRAM] for branch in [*branches, literals]]
    return wanted if all(wanted) else None


def _group_end(pattern: str, at: int) -> int:
    """The place after the group that opens at ``at``; -1 where it holds quoting or comments, which this doesn't follow."""
    depth, i = 0, at
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2] in ("Q", "c"):
                return -1
            i += 2
            continue
        if c == "[":
            i = class_end(pattern, i)
            continue
        if re.match(r"\(\?[a-zA-Z]*x", pattern[i:]):
            return -1
        depth += (c == "(") - (c == ")")
        i += 1
        if not depth:
            return i
    return -1


@dataclass(frozen=True)
class Opened:
    """What a search must read: ``paths`` (folders and files, relative to the table), and of ``folders`` the files that ``kept``
    is true of, a condition on nothing but ``_metadata.file_name``, by which the scan leaves the others unopened."""

    paths: list[str]
    folders: tuple[str, ...] = ()
    kept: Column | None = None


def files_that_may_match(files: TableFiles, folders: tuple[Folder, ...], pattern: str) -> Opened:
    """What a search must read: files of indexed folders, other folders as a whole.

    Runs one job over the rows of the indexes that a run of the pattern falls into.
    """
    spark, literals = files.spark, required_literals(pattern)
    everything = Opened([f.name for f in folders])
    indexed = [f for f in folders if _indexed(files, f)] if literals else []
    if not indexed:
        return everything
    whole = [f.name for f in folders if f not in indexed]
    runs = [
        (branch, text[i : i + GRAM])
        for branch, texts in enumerate(literals) for text in texts for i in range(len(text) - GRAM + 1)
        if text[i : i + GRAM].isascii()
    ]
    if {branch for branch, _ in runs} != set(range(len(literals))):
        return everything
    wanted = (
        spark.createDataFrame(runs, "branch int, gram string")
        .select("branch", _place(folded(F.col("gram"))).alias("place")).distinct()
        .withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("branch")))
    )
    index = spark.read.schema(_SCHEMA).parquet(*(f"{files.path}/{_places_of(f.name)}" for f in indexed))
    may = (
        index.join(F.broadcast(wanted), "place")
        .groupBy("folder", "file", "branch", "needed").agg(F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == F.col("needed")).select("folder", "file", F.lit(True).alias("may")).distinct()
    )
    known = index.where("place = 0").select("folder", "file", "name")
    # as many names as the scan would list anyway
    listed = known.join(may, ["folder", "file"], "left").select("folder", "file", "name", F.col("may").isNotNull().alias("may")).collect()
    matching = [r for r in listed if r.may]
    if len(matching) <= MOST_NAMED:
        return Opened(whole + sorted(f"{r.folder}/{r.name}" for r in matching))
    kept = {r.file for r in matching}
    dropped = {r.file for r in listed} - kept
    if not dropped:
        return everything
    few, verb = (kept, "IN") if len(kept) <= len(dropped) else (dropped, "NOT IN")
    condition = F.expr(f"xxhash64(_metadata.file_name) {verb} ({', '.join(f'{x}L' for x in sorted(few))})")
    return Opened(whole, tuple(f.name for f in indexed), condition)
