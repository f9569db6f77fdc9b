"""Live stack traces: events of a stream with the continuation lines that follow them.

Every micro-batch is read together with the rows still open from earlier batches (an event whose
context may go on, and the lines it has so far), and the batch operator for trailing context
is applied to both. Events whose context is complete are written out; the rows of the others
are carried on. What is carried is at most ``n + 1`` rows per source, lies in Parquet next to the
output, and belongs to a batch id, so a replayed batch starts from the same rows.

With a timeout the event of a source that has gone silent is written out too: once the stream's newest time lies beyond the
last line by more than the timeout. A line that comes later than that after the one before it is no context in any case, so the
answer doesn't depend on how the rows fall into batches (as long as times rise with seq). Batches come with rows, so where
all sources are silent the last events stay open until one of them speaks.

The work of a hot source is split by seq range as in the batch operator, which keyed state (one
task per source) would not allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.context import trailing_context
from ..schema import CHUNK_ROWS, DEFAULT_CONTEXT_LINES, DEFAULT_PAYLOAD_CHARS, LOG_SCHEMA
from ..session import stage

_COLUMNS = [f.name for f in LOG_SCHEMA.fields]


def _carried(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], LOG_SCHEMA)
    # a missing state is an error: what was open would be lost without a word
    return spark.read.schema(LOG_SCHEMA).parquet(f"{path}/_open/batch={batch_id - 1}")


def _clock(spark: SparkSession, path: str, batch_id: int, batch: DataFrame) -> DataFrame:
    """One row, ``now``: the newest time of the stream, this batch included; kept for the next batch."""
    now = batch.agg(F.max("timestamp").alias("now"))
    if batch_id:
        before = spark.read.schema("now timestamp").parquet(f"{path}/_clock/batch={batch_id - 1}")
        now = before.unionByName(now).agg(F.max("now").alias("now"))
    now.write.mode("overwrite").parquet(f"{path}/_clock/batch={batch_id}")
    return spark.read.schema("now timestamp").parquet(f"{path}/_clock/batch={batch_id}")


def trace_batch(
    batch: DataFrame,
    path: str,
    batch_id: int,
    anchors: Column,
    n: int = DEFAULT_CONTEXT_LINES,
    max_payload_chars: int = DEFAULT_PAYLOAD_CHARS,
    chunk_rows: int = CHUNK_ROWS,
    timeout: str | None = None,
) -> None:
    """Handle one micro-batch; idempotent per ``batch_id``. ``anchors`` must select rows with a level."""
    spark = batch.sparkSession
    rows = stage(_carried(spark, path, batch_id).unionByName(batch.select(*_COLUMNS)))
    found = trailing_context(rows, n, anchors, max_payload_chars, chunk_rows, gap=timeout)
    if timeout:
        late = F.coalesce(F.col("open_until") < _clock(spark, path, batch_id, batch).scalar(), F.lit(False))
        found = found.withColumn("closed", F.col("closed") | late).drop("open_until")
    contexts = stage(found)
    events = rows.join(contexts.drop("source"), "seq")
    events.where("closed").select(*_COLUMNS, "context").write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
    # an event with a level ends the context before it, so a source has at most one open event: its last
    open_from = contexts.where(~F.col("closed")).select(F.col("source").alias("of"), F.col("seq").alias("open_from"))
    carried = rows.join(open_from, F.col("source").eqNullSafe(F.col("of"))).where(F.col("seq") >= F.col("open_from")).select(*_COLUMNS)
    carried.write.mode("overwrite").parquet(f"{path}/_open/batch={batch_id}")


def follow_traces(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    anchors: Column,
    n: int = DEFAULT_CONTEXT_LINES,
    max_payload_chars: int = DEFAULT_PAYLOAD_CHARS,
    chunk_rows: int = CHUNK_ROWS,
    timeout: str | None = None,
    **trigger,
) -> StreamingQuery:
    """Start assembling traces from a stream of sequenced records (of the log table, say).

    ``timeout`` (an interval, say "30 SECONDS") closes the event of a source that is silent for longer.
    """
    if n < 1:
        raise ValueError("a trace has at least one line")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: trace_batch(batch, path, batch_id, anchors, n, max_payload_chars, chunk_rows, timeout)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Completed events with their context."""
    return spark.read.parquet(f"{path}/events").drop("batch")


def open_traces(
    spark: SparkSession, path: str, batch_id: int, anchors: Column, n: int = DEFAULT_CONTEXT_LINES, timeout: str | None = None
) -> DataFrame:
    """Events still open after a batch, with the lines seen so far."""
    rows = _carried(spark, path, batch_id + 1)
    return rows.join(trailing_context(rows, n, anchors, gap=timeout).select("seq", "context"), "seq")
