"""Distinct failures: matching rows folded into groups by fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fingerprint import shown, template
from ..functions.levels import level_of_rank, severity


def error_groups(matching: DataFrame) -> DataFrame:
    """One row per template of the given rows; lines that differ late are different failures.

    Columns: ``fingerprint, count, level`` (most severe), ``first_seen, last_seen, sources``
    (most rows first, then by name), ``first_seq, last_seq, last_source``.

    Only fixed-width values are aggregated over the log, first per (fingerprint, source) and
    then per fingerprint, so the first step is a hash aggregate with map-side combine and a
    fingerprint holding most of the log is spread over its sources and map tasks. The sample
    line is not dragged along: ``last_seq`` names the row to fetch it from.
    """
    per_source = (
        matching.withColumn("template", template(F.col("payload")))
        .select(
            F.md5("template").alias("key"),  # the whole template counts, its beginning is shown
            shown(F.col("template")).alias("fingerprint"),
            "source",
            "seq",
            "timestamp",
            severity(F.col("level")).alias("rank"),
        )
        .groupBy("key", "fingerprint", "source")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("rank").alias("rank"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
        )
    )
    return (
        per_source.groupBy("key", "fingerprint")
        .agg(
            F.sum("rows").alias("count"),
            F.max("rank").alias("rank"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("n"), "source"))).alias("ranked"),
            F.min("first_seq").alias("first_seq"),
            F.max("last_seq").alias("last_seq"),
            F.max_by("source", "last_seq").alias("last_source"),
        )
        .select(
            "fingerprint",
            "count",
            level_of_rank(F.col("rank")).alias("level"),
            "first_seen",
            "last_seen",
            F.col("ranked.source").alias("sources"),
            "first_seq",
            "last_seq",
            "last_source",
        )
    )


def newest_groups(groups: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most recently seen groups, newest first; ties by first appearance."""
    return groups.orderBy(F.col("last_seen").desc(), F.col("first_seq").asc()).limit(limit)
