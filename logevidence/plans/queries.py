"""Search, errors, sources, status, records."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import elide, rfc3339
from ..operators.context import context_of
from ..operators.filters import check_cursor, log_filter
from ..operators.groups import error_groups, newest_groups
from ..operators.horizon import group_envelope, record_envelope, status
from ..operators.order import newest
from ..operators.stats import source_views
from ..schema import (
    DEFAULT_CONTEXT_LINES, DEFAULT_GROUP_LIMIT, DEFAULT_PAYLOAD_CHARS, DEFAULT_RECORD_LIMIT, MAX_CONTEXT_LINES,
    MAX_LIMIT, MAX_PAYLOAD_CHARS, timestamp_type,
)
from ..session import stage


@dataclass(frozen=True)
class Result:
    """An answer: its rows, and one envelope row saying what was left out of them."""

    rows: DataFrame
    envelope: DataFrame


def _count(name: str, value, least: int, most: int | None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least or (most is not None and value > most):
        raise ValueError(f"invalid `{name}`: {value!r} (expected {least}..={'' if most is None else most})")
    return value


@dataclass(frozen=True)
class QueryArgs:
    """Arguments of a query, checked when it is made.

    A malformed value, or one over its maximum, raises ``ValueError``: an argument that is
    silently changed would look like a clean result. Empty text counts as absent.
    """

    grep: str | None = None
    source: str | None = None
    level: str | None = None
    since: str | None = None
    limit: int | None = None
    cursor: int | None = None
    max_payload_chars: int | None = None
    context_lines: int | None = None
    as_of: datetime | None = None

    def __post_init__(self):
        for name in ("grep", "source", "level", "since"):
            value = getattr(self, name)
            if value is not None and not isinstance(value, str):
                raise ValueError(f"invalid `{name}`: {value!r} (expected text)")
            if value == "":
                object.__setattr__(self, name, None)
        for name, most in (("limit", MAX_LIMIT), ("max_payload_chars", MAX_PAYLOAD_CHARS)):
            value = getattr(self, name)
            if value is not None:
                _count(name, value, 1, most)
        if self.context_lines is not None:
            _count("context_lines", self.context_lines, 0, MAX_CONTEXT_LINES)
        if self.cursor is not None:
            check_cursor(self.cursor)
        self.condition()

    def condition(self, type_name: str = "timestamp", default_level: str | None = None, cursor: bool = True) -> Column:
        return log_filter(
            grep=self.grep,
            source=self.source,
            level=self.level or default_level,
            since=self.since,
            cursor=self.cursor if cursor else None,
            as_of=self.as_of,
            type_name=type_name,
        )

    @property
    def payload_chars(self) -> int:
        return self.max_payload_chars or DEFAULT_PAYLOAD_CHARS


def elided_records(rows: DataFrame, max_chars: int = DEFAULT_PAYLOAD_CHARS) -> DataFrame:
    """Rows as they are answered: long payloads shortened and marked with their original length."""
    text, original = elide(F.col("payload"), max_chars)
    return rows.select(
        "seq", "timestamp", "source", "level", text.alias("payload"), original.alias("payload_truncated_from")
    )


def search_logs(logs: DataFrame, **arguments) -> Result:
    """The newest matching records in reading order (100 unless ``limit`` says otherwise)."""
    args = QueryArgs(**arguments)
    limit = args.limit or DEFAULT_RECORD_LIMIT
    matching = logs.where(args.condition(timestamp_type(logs)))
    return Result(
        elided_records(newest(matching, limit), args.payload_chars),
        record_envelope(logs, matching, limit, args.cursor),
    )


def recent_errors(logs: DataFrame, **arguments) -> Result:
    """Distinct failures, most recently seen first, each with a sample and its stack trace.

    Rows: ``fingerprint, count, sources, level, first_seen, last_seen, sample, context``, in
    order. Level ``error`` and above unless given. Runs two jobs: the groups are staged
    once (the envelope counts them), and of those the ones that are shown (at most
    ``MAX_LIMIT``); text and context are then looked up for these few rows only.
    """
    args = QueryArgs(**arguments)
    limit = args.limit or DEFAULT_GROUP_LIMIT
    lines = DEFAULT_CONTEXT_LINES if args.context_lines is None else args.context_lines
    groups = stage(error_groups(logs.where(args.condition(timestamp_type(logs), default_level="error"))))
    shown = stage(newest_groups(groups, limit))
    anchors = shown.select(F.col("last_seq").alias("seq"), F.col("last_source").alias("source"))
    found = context_of(logs, anchors, lines, args.payload_chars).withColumnRenamed("seq", "last_seq")
    rows = (
        F.broadcast(shown).join(found, "last_seq", "left")  # every counted group is answered
        .orderBy(F.col("last_seen").desc(), F.col("first_seq").asc())
        .select("fingerprint", "count", "sources", "level", "first_seen", "last_seen", "sample", "context")
    )
    return Result(rows, group_envelope(logs, groups, limit, args.cursor))


def log_sources(logs: DataFrame, lifecycle_events: DataFrame) -> Result:
    """Every source with its state and counters; the envelope is the log's status."""
    return Result(source_views(logs, lifecycle_events), status(logs).select("buffered", "cursor"))


def log_status(logs: DataFrame) -> DataFrame:
    return status(logs)


def records(logs: DataFrame, grep: str | None = None, source: str | None = None) -> DataFrame:
    """All retained rows in full, in order; a malformed pattern is ignored."""
    return logs.where(log_filter(grep=grep, source=source, on_error="ignore")).orderBy("seq")


def json_records(rows: DataFrame) -> DataFrame:
    """One JSON object per row in column ``value``; fields without a value and empty lists are left out."""

    def field(name: str, kind: T.DataType) -> Column:
        column = F.col(f"`{name}`")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return rfc3339(column).alias(name)
        if isinstance(kind, T.ArrayType):
            return F.when(F.size(column) > 0, column).alias(name)
        return column

    return rows.select(F.to_json(F.struct(*[field(f.name, f.dataType) for f in rows.schema])).alias("value"))
