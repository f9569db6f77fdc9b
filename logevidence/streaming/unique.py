"""Every seq of a stream once, however late its repeat comes.

What has been seen is kept as ranges of seq, cut at the borders of chunks. Numbers that are dense fold into one range per chunk of
2^20 rows, so what is kept grows with the gaps of the log, not with its rows, and no watermark has to forget anything. The ranges
lie in Parquet next to the output and belong to a batch id, so a replayed batch starts from the same ranges. A micro-batch writes
the ranges that it adds, merged with those of as many batches before it as the binary form of its id says, so that a range is
rewritten a logarithmic number of times however many batches come; what was seen before a batch lies in as few folders. It reads
the ranges of its own chunks alone and meets them in one sort by chunk and seq, never row by row with all ranges of a chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.order import chunk_of
from ..schema import CHUNK_ROWS
from ..session import stage, unstage

RANGES = "chunk bigint, first bigint, last bigint"
#: Chunks of a micro-batch up to this number are looked up by name, more of them from the least to the greatest.
MOST_CHUNKS = 1_000


def _ranges(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """The ranges that some batches have written."""
    if not batches:
        return spark.createDataFrame([], RANGES)
    # a missing state is an error: repeats would come through without a word
    return spark.read.schema(RANGES).parquet(*(f"{path}/_seen/batch={i}" for i in batches))


def _spans(batch_id: int) -> list[int]:
    """The batches whose ranges together are those of all batches before ``batch_id``, newest first.

    Batch i holds the ranges of the batches from i + 1 - 2^k on, where 2^k is the greatest power of two that divides i + 1.
    """
    spans = []
    while batch_id:
        spans.append(batch_id - 1)
        batch_id &= batch_id - 1
    return spans


def _seen(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The ranges of all batches before ``batch_id``."""
    return folded(_ranges(spark, path, _spans(batch_id)))


def folded(ranges: DataFrame) -> DataFrame:
    """Ranges of seq, of which those that touch or overlap within a chunk are one."""
    before = Window.partitionBy("chunk").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("chunk").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.coalesce((F.col("first") > F.max("last").over(before) + 1).cast("int"), F.lit(1))
    return (
        ranges.withColumn("starts", starts).withColumn("nth", F.sum("starts").over(upto))
        .groupBy("chunk", "nth").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select("chunk", "first", "last")
    )


def unique_batch(batch: DataFrame, path: str, batch_id: int, chunk_rows: int = CHUNK_ROWS) -> None:
    """Handle one micro-batch; idempotent per ``batch_id``.

    Rows without a seq can't be told apart: all of them are written. Rows that share a seq are the same row; one of them stays.
    """
    spark, columns = batch.sparkSession, batch.columns
    rows = stage(batch.withColumn("_chunk", chunk_of(F.col("seq"), chunk_rows)))
    numbered = rows.where("seq IS NOT NULL").select("_chunk", F.col("seq").alias("_first"), F.lit(None).cast("bigint").alias("_last"), *columns)
    seen = _ranges(spark, path, _spans(batch_id)).select(
        F.col("chunk").alias("_chunk"), F.col("first").alias("_first"), F.col("last").alias("_last")
    )
    touched = numbered.select("_chunk").distinct().limit(MOST_CHUNKS + 1).collect()
    if len(touched) <= MOST_CHUNKS:
        seen = seen.where(F.col("_chunk").isin([r["_chunk"] for r in touched]))
    else:
        seen = seen.where(F.col("_chunk").between(*numbered.agg(F.min("_chunk"), F.max("_chunk")).first()))
    # ranges come before the rows that begin with them; a row is new if no range reaches it and no row before it has its seq
    order = Window.partitionBy("_chunk").orderBy("_first", F.col("_last").desc_nulls_last())
    reached = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    repeats = F.col("_last").isNull() & F.lag(F.when(F.col("_last").isNull(), F.col("_first"))).over(order).eqNullSafe(F.col("_first"))
    fresh = (
        numbered.unionByName(seen, allowMissingColumns=True)
        .withColumn("_reached", reached).withColumn("_repeats", repeats)
        .where("_last IS NULL AND NOT _repeats AND (_reached IS NULL OR _reached < _first)")
    )
    written = f"{path}/rows/batch={batch_id}"
    fresh.select(*columns).unionByName(rows.where("seq IS NULL").select(*columns)).write.mode("overwrite").parquet(written)
    unstage(rows)
    seq = F.col("seq")
    new = spark.read.schema("seq bigint").parquet(written).where("seq IS NOT NULL").select(
        chunk_of(seq, chunk_rows).alias("chunk"), seq.alias("first"), seq.alias("last")
    )
    before = [i for i in _spans(batch_id) if i not in _spans(batch_id + 1)]
    folded(_ranges(spark, path, before).unionByName(new)).write.mode("overwrite").parquet(f"{path}/_seen/batch={batch_id}")


def follow_unique(stream: DataFrame, path: str, checkpoint: str, chunk_rows: int = CHUNK_ROWS, **trigger) -> StreamingQuery:
    """Start writing each seq of a stream of records once."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: unique_batch(batch, path, batch_id, chunk_rows)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_unique(spark: SparkSession, path: str) -> DataFrame:
    """The rows that `follow_unique` has written."""
    return spark.read.parquet(f"{path}/rows").drop("batch")
