"""Counters per source kept beside the folders of a log table, so that statistics of the table read no event rows.

``<path>/_summaries/<folder>/*.parquet`` holds one row per source of a folder. Every column can be merged (sums, least and
greatest seq with what belongs to them), so the counters of a version are those of its folders, merged on read. A summary is
written before the version that names its folder, and goes with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.stats import counters_with_last_line, merged_counters, source_counters
from ..schema import LOG_SCHEMA
from ..session import unstage
from .manifest import Folder, TableFiles, Version, at_version, latest

#: ``first_seq, last_seq`` bound the rows of a source; the times and the line are those of these rows.
SUMMARY = (
    "name string, total bigint, errors bigint, warns bigint, first_seen timestamp, last_seen timestamp, first_seq bigint,"
    " last_seq bigint, last_line string"
)


def summary_of(name: str) -> str:
    return f"_summaries/{name}"


def write_summary(spark: SparkSession, path: str, name: str) -> Folder:
    """Summarise a written folder; returns what it holds."""
    rows = spark.read.schema(LOG_SCHEMA).parquet(f"{path}/{name}")
    counters = counters_with_last_line(rows)
    summary = f"{path}/{summary_of(name)}"
    counters.select(*(c.split()[0] for c in SUMMARY.split(", "))).coalesce(1).write.mode("overwrite").parquet(summary)
    unstage(counters)
    sums = spark.read.schema(SUMMARY).parquet(summary).agg(F.sum("total"), F.min("first_seq"), F.max("last_seq")).first()
    return Folder(name, sums[0] or 0, sums[1], sums[2], summary=True)


def read_counters(spark: SparkSession, path: str, version: int | None = None, lines: bool = True) -> DataFrame:
    """Counters of every source of the newest version (or of another): the columns of ``SUMMARY``.

    Event rows are read only of folders through which an eviction cuts (at most one, since seq rises with the folders) and
    of those written before summaries were kept. A table without rows gives none. Without ``lines``, ``last_line`` may be null,
    no payload is read, and no job is run.
    """
    files = TableFiles(spark, path)
    return counters_of(files, latest(files) if version is None else at_version(files, version), lines)


def counters_of(files: TableFiles, version: Version, lines: bool = True) -> DataFrame:
    spark = files.spark
    kept = [f for f in version.folders if f.summary and f.first > version.floor]
    cut = [f for f in version.folders if not (f.summary and f.first > version.floor)]
    found = spark.createDataFrame([], SUMMARY)
    if kept:
        found = spark.read.schema(SUMMARY).parquet(*(f"{files.path}/{summary_of(f.name)}" for f in kept))
    if cut:
        rows = spark.read.schema(LOG_SCHEMA).parquet(*(f"{files.path}/{f.name}" for f in cut)).where(F.col("seq") > version.floor)
        counted = counters_with_last_line(rows) if lines else source_counters(rows).withColumn("last_line", F.lit(None).cast("string"))
        found = found.unionByName(counted.select(*found.columns))
    return merged_counters(found)
