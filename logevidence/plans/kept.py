"""Answers from what is kept beside a log table: statistics from its counters, which read no rows, and searches that open few files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.horizon import horizon_of, record_envelope_of, status_of
from ..operators.order import newest
from ..operators.stats import ranked_stats, totals_of, views_of
from ..schema import DEFAULT_RECORD_LIMIT
from ..sources.log_table import read_log_table
from ..sources.manifest import TableFiles, latest
from ..sources.summaries import read_counters
from .queries import QueryArgs, Result, elided_records


def table_source_stats(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """`source_stats` of a log table."""
    return ranked_stats(read_counters(spark, path, version))


def table_source_totals(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """`source_totals` of a log table."""
    return totals_of(read_counters(spark, path, version, lines=False))


def table_horizon(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """`horizon` of a log table."""
    return horizon_of(read_counters(spark, path, version, lines=False))


def table_status(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """`log_status` of a log table."""
    return status_of(read_counters(spark, path, version, lines=False))


def table_sources(spark: SparkSession, path: str, lifecycle_events: DataFrame, version: int | None = None) -> Result:
    """`log_sources` of a log table: every source with its state and counters, and the status of the log."""
    counters = read_counters(spark, path, version)
    return Result(views_of(counters, lifecycle_events), status_of(counters).select("buffered", "cursor"))


def search_table(spark: SparkSession, path: str, **arguments) -> Result:
    """`search_logs` of a log table as it is now.

    Opens only folders with rows after the cursor and files that may hold what ``grep`` looks for; the horizon comes from
    the counters.
    """
    args = QueryArgs(**arguments)
    limit, version = args.limit or DEFAULT_RECORD_LIMIT, latest(TableFiles(spark, path)).number or None
    rows = read_log_table(spark, path, version=version, after=args.cursor, grep=args.grep)
    matching = rows.where(replace(args, grep=None).condition())
    return Result(
        elided_records(newest(matching, limit), args.payload_chars),
        record_envelope_of(table_horizon(spark, path, version), matching, limit, args.cursor),
    )
