"""Live reading: follow with a filter, history plus live, cursor polling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import filter_logs
from ..operators.horizon import record_envelope
from ..operators.merge import dedup_by_seq
from ..plans.queries import Result, elided_records, json_records


def follow(stream: DataFrame, **conditions) -> DataFrame:
    """Every new record that passes the filter, as one JSON object per row (column ``value``).

    A malformed pattern is ignored, as in an unattended live view.
    """
    return json_records(filter_logs(stream, on_error="ignore", **conditions))


def follow_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **conditions) -> StreamingQuery:
    """Start writing `follow` to text files, exactly once."""
    writer = follow(stream, **conditions).writeStream.format("text").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def unique_by_seq(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream in which every seq appears once.

    Rows with the same seq are the same row, so the first one is as good as the last. State is
    bounded by the watermark; the log's ``timestamp`` must be of type TIMESTAMP for it. Repeats that come more
    than ``delay`` later may pass; `follow_unique` lets none pass.
    """
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["seq"])


def hydrate_and_follow(
    history: Callable[[], DataFrame], stream: DataFrame, live_path: str, checkpoint: str, keep: int | None = None, **trigger
) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Follow a stream and see it together with the history, without gap and without doubles.

    The stream is started first and lands its rows under ``live_path``; the history is read
    afterwards, so a row may be in both, never in neither. Returns the running query and a
    function giving the merged view (all rows, or the newest ``keep``) as of its call.
    """
    writer = stream.writeStream.format("parquet").option("path", live_path).option("checkpointLocation", checkpoint)
    query = (writer.trigger(**trigger) if trigger else writer).start()
    schema, spark = stream.schema, stream.sparkSession

    def view() -> DataFrame:
        try:
            live = [spark.read.schema(schema).parquet(live_path)]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            live = []  # nothing has arrived yet
        return dedup_by_seq(history(), *live, keep=keep)

    return query, view


def read_after(logs: DataFrame, cursor: int, **conditions) -> Result:
    """One step of an incremental read: everything after ``cursor``, in full.

    Pass the envelope's ``next_cursor`` to the next step; ``cursor_gap`` says that rows were
    lost in between. Streams of the log table do the same without a cursor.
    """
    matching = filter_logs(logs, cursor=cursor, **conditions)
    return Result(
        elided_records(matching, max_chars=(1 << 31) - 1).orderBy("seq"),
        record_envelope(logs, matching, 1 << 62, cursor),
    )
