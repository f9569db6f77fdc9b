"""Sources: counters, lifecycle, and the two together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import elide
from ..schema import LAST_LINE_CHARS
from ..session import stage

# Display order of lifecycle states.
STATUS_ORDER = ("failed", "exited", "starting", "running")


def source_counters(logs: DataFrame) -> DataFrame:
    """``name, total, errors, warns, first_seen, last_seen, first_seq, last_seq`` per source.

    Fixed-width values only, so this is one hash aggregate with map-side combine and reads no payload.
    """
    return logs.groupBy(F.col("source").alias("name")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warn").alias("warns"),
        F.min_by("timestamp", "seq").alias("first_seen"),
        F.max_by("timestamp", "seq").alias("last_seen"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def merged_counters(parts: DataFrame) -> DataFrame:
    """Counters of a log from those of its parts, ``last_line`` included; seq ranges of the parts may interleave."""
    return parts.groupBy("name").agg(
        *(F.sum(c).alias(c) for c in ("total", "errors", "warns")),
        F.min_by("first_seen", "first_seq").alias("first_seen"),
        F.max_by("last_seen", "last_seq").alias("last_seen"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.max_by("last_line", "last_seq").alias("last_line"),
    )


def source_stats(logs: DataFrame) -> DataFrame:
    """Counters of every source with its newest line, noisiest in errors first.

    Columns: ``name, total, errors, warns, last_seen, last_line``. Runs one job: the counters
    are staged, then the newest line of each source is fetched by its seq, reading only what
    is newer than the oldest of those seqs.
    """
    return ranked_stats(counters_with_last_line(logs))


def ranked_stats(counters: DataFrame) -> DataFrame:
    """Sources with their newest line, noisiest in errors first, from counters."""
    return (
        counters.orderBy(F.col("errors").desc(), F.col("total").desc(), F.col("first_seq").asc())
        .select("name", "total", "errors", "warns", "last_seen", "last_line")
    )


def counters_with_last_line(logs: DataFrame) -> DataFrame:
    """`source_counters` with ``last_line``; runs one job, which stages the counters."""
    counters = stage(source_counters(logs))
    oldest_wanted = counters.agg(F.min("last_seq")).scalar()
    lines = logs.where(F.col("seq") >= oldest_wanted).select(
        F.col("seq").alias("last_seq"), elide(F.col("payload"), LAST_LINE_CHARS)[0].alias("last_line")
    )
    # seq is unique: no skew if the join has to shuffle, no shuffle at all while the counters are small
    return lines.join(counters, "last_seq")


def source_totals(logs: DataFrame) -> DataFrame:
    """Rows per source in order of first appearance, after one line for all of them.

    Columns: ``position, source, total``. The rollup runs over the per-source counts, not over the log.
    """
    return totals_of(logs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("total"), F.min("seq").alias("first_seq")))


def totals_of(counters: DataFrame) -> DataFrame:
    """`source_totals` from counters."""
    counts = counters.select(F.col("name").alias("source"), F.col("total").alias("n"), "first_seq")
    rolled = counts.rollup("source", "first_seq").agg(F.sum("n").alias("total"), F.grouping_id().alias("g"))
    return (
        rolled.where(F.col("g").isin(0, 3))
        .select(
            F.when(F.col("g") == 3, F.lit(0)).otherwise(F.col("first_seq")).alias("position"),
            F.when(F.col("g") == 3, F.lit("all")).otherwise(F.col("source")).alias("source"),
            "total",
        )
        .orderBy("position")
    )


def lifecycle_state(events: DataFrame) -> DataFrame:
    """Latest lifecycle event per source: ``name, status, detail, changed_at``.

    Of events with one time that with the highest ``seq`` counts, where the events have that column.
    """
    order = F.struct("changed_at", "seq") if "seq" in events.columns else F.col("changed_at")
    latest = F.max_by(F.struct("status", "detail"), order)
    return (
        events.groupBy("name")
        .agg(latest.alias("s"), F.max("changed_at").alias("changed_at"))
        .select("name", "s.status", "s.detail", "changed_at")
    )


def status_rank(status: Column) -> Column:
    case = None
    for rank, name in enumerate(STATUS_ORDER):
        case = F.when(status == name, rank) if case is None else case.when(status == name, rank)
    return case.otherwise(len(STATUS_ORDER))


def source_views(logs: DataFrame, lifecycle_events: DataFrame) -> DataFrame:
    """Registered and observed sources with their counters, the ones in trouble first.

    A registered source without rows has zero counts; a source that only shows up in the log is
    ``observed``, as of its last line.
    """
    return views_of(counters_with_last_line(logs), lifecycle_events)


def views_of(counters: DataFrame, lifecycle_events: DataFrame) -> DataFrame:
    """`source_views` from counters."""
    stats = counters.drop("first_seen", "first_seq", "last_seq")
    state = lifecycle_state(lifecycle_events)
    return (
        state.join(stats, "name", "full_outer")
        .select(
            "name",
            F.coalesce("status", F.lit("observed")).alias("status"),
            "detail",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("errors", F.lit(0)).alias("errors"),
            F.coalesce("warns", F.lit(0)).alias("warns"),
            "last_seen",
            "last_line",
            F.coalesce("changed_at", "last_seen").alias("status_changed_at"),
        )
        .orderBy(status_rank(F.col("status")), F.col("errors").desc(), F.col("name").asc())
    )
