"""What the log can and cannot see: its horizon, cursor gaps, and answer envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import __version__


def horizon(logs: DataFrame) -> DataFrame:
    """One row: ``buffer_start_cursor, next_cursor`` (0 when empty), ``buffer_starts_at``.

    Always of the whole log, not of an answer. Reads ``seq`` and ``timestamp`` only.
    """
    return logs.agg(
        F.min("seq").alias("buffer_start_cursor"),
        F.coalesce(F.max("seq"), F.lit(0)).alias("next_cursor"),
        F.min_by("timestamp", "seq").alias("buffer_starts_at"),
    )


def horizon_of(counters: DataFrame) -> DataFrame:
    """`horizon` from counters per source."""
    return counters.agg(
        F.min("first_seq").alias("buffer_start_cursor"),
        F.coalesce(F.max("last_seq"), F.lit(0)).alias("next_cursor"),
        F.min_by("first_seen", "first_seq").alias("buffer_starts_at"),
    )


def cursor_gap(cursor: int | Column | None) -> Column:
    """Over a `horizon` row: rows after ``cursor`` were lost, or it lies beyond the log."""
    if cursor is None:
        return F.lit(False)
    c = F.lit(cursor) if isinstance(cursor, int) else cursor
    start, latest = F.col("buffer_start_cursor"), F.col("next_cursor")
    # `c < start - 1` instead of `c + 1 < start`: cannot overflow at the largest cursor
    return F.when(start.isNull(), c > 0).otherwise((c < start - 1) | (c > latest))


def record_envelope(logs: DataFrame, matching: DataFrame, limit: int, cursor: int | None) -> DataFrame:
    """One row that goes with an answer of records.

    Counting and horizon are two scans on purpose: the count gets the filter pushed down,
    the horizon touches two narrow columns.
    """
    return record_envelope_of(horizon(logs), matching, limit, cursor)


def record_envelope_of(seen: DataFrame, matching: DataFrame, limit: int, cursor: int | None) -> DataFrame:
    """`record_envelope` from the log's `horizon`."""
    total = matching.agg(F.count(F.lit(1))).scalar()
    return (
        seen
        .withColumn("total_matching", total)
        .select(
            "total_matching",
            (F.col("total_matching") > limit).alias("truncated"),
            "next_cursor",
            "buffer_start_cursor",
            cursor_gap(cursor).alias("cursor_gap"),
        )
    )


def group_envelope(logs: DataFrame, groups: DataFrame, limit: int, cursor: int | None) -> DataFrame:
    """One row that goes with an answer of groups."""
    sums = groups.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_matching"), F.count(F.lit(1)).alias("distinct")
    )
    counted = sums.select(F.struct("total_matching", "distinct")).scalar()
    return (
        horizon(logs)
        .withColumn("c", counted)
        .select(
            "c.total_matching",
            "c.distinct",
            (F.col("c.distinct") > limit).alias("truncated"),
            "buffer_starts_at",
            "next_cursor",
            "buffer_start_cursor",
            cursor_gap(cursor).alias("cursor_gap"),
        )
    )


def status(logs: DataFrame) -> DataFrame:
    """One row: rows retained, latest cursor, library version."""
    return logs.agg(
        F.lit(True).alias("ok"),
        F.lit(__version__).alias("version"),
        F.count(F.lit(1)).alias("buffered"),
        F.coalesce(F.max("seq"), F.lit(0)).alias("cursor"),
    )


def status_of(counters: DataFrame) -> DataFrame:
    """`status` from counters per source."""
    return counters.agg(
        F.lit(True).alias("ok"),
        F.lit(__version__).alias("version"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("buffered"),
        F.coalesce(F.max("last_seq"), F.lit(0)).alias("cursor"),
    )


def filtered_count(logs: DataFrame, condition: Column) -> DataFrame:
    """One row, ``total``: rows that pass an interactive filter."""
    return logs.agg(F.count_if(condition).alias("total"))
