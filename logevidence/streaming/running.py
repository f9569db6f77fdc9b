"""Counters and groups kept current as rows arrive (streaming aggregations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fingerprint import shown, template
from ..functions.levels import level_of_rank, severity
from ..functions.text import elide
from ..schema import DEFAULT_PAYLOAD_CHARS, LAST_LINE_CHARS


def running_source_stats(stream: DataFrame) -> DataFrame:
    """Counters per source; write in update or complete mode. State: one row per source."""
    newest = F.max_by(F.struct("timestamp", elide(F.col("payload"), LAST_LINE_CHARS)[0].alias("line")), "seq")
    return (
        stream.groupBy(F.col("source").alias("name"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("level") == "error").alias("errors"),
            F.count_if(F.col("level") == "warn").alias("warns"),
            newest.alias("newest"),
        )
        .select(
            "name", "total", "errors", "warns", F.col("newest.timestamp").alias("last_seen"),
            F.col("newest.line").alias("last_line"),
        )
    )


def running_error_groups(stream: DataFrame) -> DataFrame:
    """Groups of the rows of a (filtered) stream, without context; update or complete mode.

    State: one bounded row per fingerprint. Counts per source stay out of the state; the exact
    list, like the context, comes from the batch query over the log.
    """
    sample = F.max_by(elide(F.col("payload"), DEFAULT_PAYLOAD_CHARS)[0], "seq")
    whole = template(F.col("payload"))
    return (
        stream.groupBy(F.md5(whole).alias("key"), shown(whole).alias("fingerprint"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.max(severity(F.col("level"))).alias("rank"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            sample.alias("sample"),
        )
        .withColumn("level", level_of_rank(F.col("rank")))
        .drop("rank", "key")
    )
