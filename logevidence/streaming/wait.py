"""Wait for a record to appear, and answer with the burst that began with it."""

from __future__ import annotations

import inspect
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.horizon import horizon, cursor_gap
from ..operators.order import burst_from, first_match_after, latest_match
from ..plans.queries import QueryArgs, Result, elided_records
from ..schema import (
    DEFAULT_RECORD_LIMIT, DEFAULT_SETTLE_MS, DEFAULT_TIMEOUT_MS, LOG_SCHEMA, MAX_TIMEOUT_MS, timestamp_type,
)
from ..session import staging_path

_POLL_MS = 100


def wait_for_logs(
    logs: Callable[[], DataFrame],
    stream: DataFrame | None = None,
    timeout_ms: int = DEFAULT_TIMEOUT_MS,
    require_new: bool = False,
    settle_ms: int = DEFAULT_SETTLE_MS,
    **arguments,
) -> Result:
    """The burst from the first matching record on; runs jobs until it is there or time is up.

    ``logs`` reads the retained log afresh on every call; where it takes ``after`` (`partial(read_log_table, spark, path)`
    does), what is new is looked for in the batches after the snapshot alone. A match already in it answers at once
    (``matched_from_buffer``) unless ``require_new``. Otherwise the first match with a seq
    above the log's newest at the time of the call ends the wait: it is looked for in ``stream``
    (a streaming read of the log) where given, else by reading what is new in the log again
    and again. The envelope also says ``matched`` and ``waited_ms``.
    """
    if isinstance(require_new, bool) is False:
        raise ValueError(f"invalid `require_new`: {require_new!r} (expected true or false)")
    if isinstance(timeout_ms, bool) or not isinstance(timeout_ms, int) or not 0 <= timeout_ms <= MAX_TIMEOUT_MS:
        raise ValueError(f"invalid `timeout_ms`: {timeout_ms!r} (expected 0..={MAX_TIMEOUT_MS})")
    args = QueryArgs(**arguments)
    started = time.monotonic()
    deadline = started + timeout_ms / 1000

    buffered = logs()
    condition = args.condition(timestamp_type(buffered))
    snapshot = buffered.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    if not require_new:
        anchor = latest_match(buffered.where(F.col("seq") <= snapshot), condition).first()[0]
        if anchor is not None:
            return _burst(buffered, anchor, args, 0, True)

    find = _find_in_stream if stream is not None else _find_in_log
    anchor = find(stream if stream is not None else logs, condition, snapshot, deadline)
    waited = int((time.monotonic() - started) * 1000)
    if anchor is None:
        return _nothing(logs(), args, waited)
    if stream is not None:
        _until_retained(logs, anchor, deadline)
    time.sleep(settle_ms / 1000)
    return _burst(logs(), anchor, args, int((time.monotonic() - started) * 1000), False)


def _newer(logs: Callable[..., DataFrame], cursor: int) -> DataFrame:
    """Rows after the cursor: a reader that takes it looks into newer folders alone; it is pushed into the scan of any other."""
    rows = logs(after=cursor) if "after" in inspect.signature(logs).parameters else logs()
    return rows.where(F.col("seq") > cursor)


def _until_retained(logs: Callable[..., DataFrame], anchor: int, deadline: float) -> None:
    """Waits for a record that a stream has seen to be part of the log: files of a batch can be seen before a version names it."""
    while _newer(logs, anchor - 1).isEmpty() and time.monotonic() < deadline:
        time.sleep(_POLL_MS / 1000)


def _find_in_log(logs, condition, snapshot, deadline) -> int | None:
    while True:
        anchor = first_match_after(_newer(logs, snapshot), condition, snapshot).first()[0]
        if anchor is not None or time.monotonic() >= deadline:
            return anchor
        time.sleep(min(_POLL_MS / 1000, max(deadline - time.monotonic(), 0)))


def _find_in_stream(stream, condition, snapshot, deadline) -> int | None:
    found, seen = threading.Event(), []

    def look(batch: DataFrame, _: int) -> None:
        if not found.is_set():
            anchor = first_match_after(batch, condition, snapshot).first()[0]
            if anchor is not None:
                seen.append(anchor)
                found.set()

    checkpoint = staging_path(stream.sparkSession, "wait")
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(look).start()
    try:
        while not found.is_set() and time.monotonic() < deadline:
            left = deadline - time.monotonic()
            if found.wait(max(min(_POLL_MS / 1000, left), 0)):
                break
            if not query.isActive:
                query.awaitTermination()  # raises what ended the stream
                break
    finally:
        query.stop()
    return seen[0] if seen else None


def _envelope(logs: DataFrame, cursor: int | None, **fields) -> DataFrame:
    answer = horizon(logs)
    for name, value in fields.items():
        answer = answer.withColumn(name, value)
    return answer.select(
        *fields, "next_cursor", "buffer_start_cursor", cursor_gap(cursor).alias("cursor_gap")
    )


def _burst(logs: DataFrame, anchor: int, args: QueryArgs, waited_ms: int, from_buffer: bool) -> Result:
    limit = args.limit or DEFAULT_RECORD_LIMIT
    total = logs.where(F.col("seq") >= anchor).agg(F.count(F.lit(1))).scalar()
    envelope = _envelope(
        logs,
        max(anchor - 1, 0),
        matched=F.lit(True),
        matched_from_buffer=F.lit(from_buffer),
        total_matching=total,
        truncated=F.col("total_matching") > limit,
        waited_ms=F.lit(waited_ms).cast("bigint"),
    )
    return Result(elided_records(burst_from(logs, anchor, limit), args.payload_chars), envelope)


def _nothing(logs: DataFrame, args: QueryArgs, waited_ms: int) -> Result:
    envelope = _envelope(
        logs,
        args.cursor,
        matched=F.lit(False),
        matched_from_buffer=F.lit(False),
        total_matching=F.lit(0).cast("bigint"),
        truncated=F.lit(False),
        waited_ms=F.lit(waited_ms).cast("bigint"),
    )
    rows = logs.sparkSession.createDataFrame([], LOG_SCHEMA)
    return Result(elided_records(rows, args.payload_chars), envelope)
