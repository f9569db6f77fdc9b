"""Order, top-k and position: operators that depend on where a row stands in the log.

None of them sorts the log or sends it to one task. The log is seen as chunks of
``chunk_rows`` consecutive sequence numbers; counting rows per chunk (a hash aggregate over
``seq`` alone) tells which chunks can hold the wanted rows, and only those are read again,
with the bound pushed into the scan as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import CHUNK_ROWS, DEFAULT_CAPACITY, TAIL_LINES
from ..session import stage

def chunk_of(seq: Column, chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(seq / chunk_rows) if chunk_rows & (chunk_rows - 1) else F.shiftright(
        seq, chunk_rows.bit_length() - 1
    )


def seq_histogram(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows per chunk: ``chunk, rows``. One small row for every ``chunk_rows`` of the log."""
    return df.groupBy(chunk_of(F.col("seq"), chunk_rows).alias("chunk")).agg(F.count(F.lit(1)).alias("rows"))


def _running(histogram: DataFrame, *order: Column) -> DataFrame:
    """Adds ``before``: rows in the chunks that come earlier in ``order``."""
    # the only window without a partition key; its input is the histogram, not the log
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumn("before", F.sum("rows").over(w) - F.col("rows"))


def newest(df: DataFrame, n: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The ``n`` rows with the highest seq, oldest of them first."""
    reached = _running(seq_histogram(df, chunk_rows), F.col("chunk").desc()).where(F.col("before") < n)
    floor = reached.agg(F.min("chunk") * F.lit(chunk_rows)).scalar()
    return df.where(F.col("seq") >= floor).orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


def oldest(df: DataFrame, n: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The ``n`` rows with the lowest seq, in order."""
    reached = _running(seq_histogram(df, chunk_rows), F.col("chunk").asc()).where(F.col("before") < n)
    ceiling = reached.agg((F.max("chunk") + 1) * F.lit(chunk_rows)).scalar()
    return df.where(F.col("seq") < ceiling).orderBy(F.col("seq").asc()).limit(n)


def page_slice(
    df: DataFrame, scroll: int, height: int, follow: bool = False, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``height`` rows in reading order after skipping ``scroll``, clamped to the last full page.

    ``follow`` shows the last page whatever ``scroll`` says. Otherwise one job runs: the few
    chunks that the page touches are staged.
    """
    if follow:
        return newest(df, height, chunk_rows)
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    counted = _running(seq_histogram(df, chunk_rows), F.col("chunk").asc()).withColumn(
        "start", F.least(F.lit(scroll), F.greatest(total - height, F.lit(0)))
    )
    touched = stage(
        counted.where(
            (F.col("before") < F.col("start") + height) & (F.col("before") + F.col("rows") > F.col("start"))
        )
    )
    lo = touched.agg(F.min("chunk") * F.lit(chunk_rows)).scalar()
    hi = touched.agg((F.max("chunk") + 1) * F.lit(chunk_rows)).scalar()
    # every touched chunk holds at least one row of the page, so there are at most `height` of them
    bounds = F.broadcast(touched.select("chunk", "before", "start"))
    in_chunk = Window.partitionBy("chunk").orderBy("seq")
    return (
        df.where((F.col("seq") >= lo) & (F.col("seq") < hi))
        .withColumn("chunk", chunk_of(F.col("seq"), chunk_rows))
        .join(bounds, "chunk")
        .withColumn("rank", F.col("before") + F.row_number().over(in_chunk) - 1)
        .where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + height))
        .select(*df.columns)
        .orderBy("seq")
    )


def retain_newest(
    logs: DataFrame, n: int = DEFAULT_CAPACITY, dense: bool = False, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Only the newest ``n`` rows (at least one), in no particular order; any ``n`` is fine.

    The result is a filter on ``seq``: nothing is sorted or moved. One job counts rows per chunk;
    ``dense=True`` states that seq has no gaps, which saves it.
    """
    n = max(n, 1)
    if dense:
        return logs.where(F.col("seq") > (logs.agg(F.max("seq") - F.lit(n))).scalar())
    counted = _running(seq_histogram(logs, chunk_rows), F.col("chunk").desc())
    edge = stage(counted.where(F.col("before") < n).agg(F.min("chunk").alias("chunk"), F.max("before").alias("before")))
    # the chunk that the n-th newest row lies in, and how many of its rows stay
    in_chunk = Window.partitionBy("chunk").orderBy(F.col("seq").desc())
    lo = edge.select(F.col("chunk") * F.lit(chunk_rows)).scalar()
    hi = edge.select((F.col("chunk") + 1) * F.lit(chunk_rows)).scalar()
    keep = edge.select(F.lit(n) - F.col("before")).scalar()
    cut = (
        logs.select("seq", chunk_of(F.col("seq"), chunk_rows).alias("chunk"))
        .where((F.col("seq") >= lo) & (F.col("seq") < hi))
        .withColumn("r", F.row_number().over(in_chunk))
        .where(F.col("r") <= keep)
        .agg(F.min("seq"))
    )
    return logs.where(F.col("seq") >= cut.scalar())


def tail_per_source(logs: DataFrame, n: int = TAIL_LINES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The last ``n`` rows of every source.

    Counting rows per source and chunk gives each source the chunk its tail begins in. Rows
    before that are dropped by the join, so the ranking sees ``n`` rows and one chunk
    per source at most. Runs one job (the table of tail positions is staged, so that it is
    broadcast exactly when it is small).
    """
    counts = logs.groupBy("source", chunk_of(F.col("seq"), chunk_rows).alias("chunk")).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("source").orderBy(F.col("chunk").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    starts = stage(
        counts.withColumn("before", F.sum("rows").over(w) - F.col("rows"))
        .where(F.col("before") < n)
        .groupBy(F.col("source").alias("of"))
        .agg((F.min("chunk") * F.lit(chunk_rows)).alias("tail_start"))
    )
    lowest = starts.agg(F.min("tail_start")).scalar()
    by_source = Window.partitionBy("source").orderBy(F.col("seq").desc())
    return (
        logs.where(F.col("seq") >= lowest)
        .join(starts, F.col("source").eqNullSafe(F.col("of")))  # rows without a source have a tail too
        .where(F.col("seq") >= F.col("tail_start"))
        .withColumn("r", F.row_number().over(by_source))
        .where(F.col("r") <= n)
        .select(*logs.columns)
    )


def assign_seq(df: DataFrame, *order_by: str | Column, start: int = 1) -> DataFrame:
    """Adds ``seq``: gap-free numbers from ``start`` in the given order.

    ``order_by`` must be a total order. The rows are range-partitioned and sorted once and
    staged with their position inside the partition (runs one job); partition counts then give
    each partition its offset. The counts are as few as the partitions.
    """
    position = F.monotonically_increasing_id()
    staged = stage(
        df.orderBy(*order_by)
        .withColumn("_part", F.shiftright(position, 33))
        .withColumn("_at", position.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    offsets = _running(counts, F.col("_part")).select("_part", "before")
    return (
        staged.join(F.broadcast(offsets), "_part")
        .withColumn("seq", F.col("before") + F.col("_at") + F.lit(start))
        .select("seq", *[c for c in df.columns if c != "seq"])
    )


def latest_match(logs: DataFrame, condition: Column) -> DataFrame:
    """One row, ``seq``: the highest matching seq, null when nothing matches."""
    return logs.where(condition).agg(F.max("seq").alias("seq"))


def first_match_after(logs: DataFrame, condition: Column, cursor: int) -> DataFrame:
    """One row, ``seq``: the lowest matching seq above ``cursor``, null when there is none."""
    return logs.where((F.col("seq") > cursor) & condition).agg(F.min("seq").alias("seq"))


def burst_from(logs: DataFrame, anchor: DataFrame | int, limit: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The first ``limit`` rows from the anchor on, whatever they are, in order."""
    start = F.lit(anchor) if isinstance(anchor, int) else anchor.scalar()
    return oldest(logs.where(F.col("seq") >= start), limit, chunk_rows)


def settled_burst(logs: DataFrame, anchor: DataFrame | int, settle: str) -> DataFrame:
    """The rows from the anchor on that landed within ``settle`` (an interval, say "2 MINUTES") after it.

    This is what a wait sees that lets a burst settle before it answers; an anchor without a time gives none but itself.
    """
    start = F.lit(anchor) if isinstance(anchor, int) else anchor.scalar()
    until = logs.where(F.col("seq") == start).agg(F.max("timestamp") + F.expr(f"INTERVAL {settle}")).scalar()
    return logs.where((F.col("seq") == start) | ((F.col("seq") > start) & (F.col("timestamp") <= until)))


def with_position(rows: DataFrame) -> DataFrame:
    """Adds ``position``, counted from 1 in the order of ``seq``, to an answer of bounded size, so that its order can be stored."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy("seq")).cast("bigint"))
