"""Trailing context: the continuation lines (a stack trace) that follow an event.

From a row of source S the later rows of S are read in order, rows of other sources being
skipped, up to the first row that starts a new event (it has a level, or is blank) or until
``n`` lines are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import elide, is_blank
from ..schema import CHUNK_ROWS, DEFAULT_CONTEXT_LINES, DEFAULT_PAYLOAD_CHARS
from ..session import stage
from .order import chunk_of

_BREAK, _ANCHOR = 1, 2  # bits of the `kind` column
#: Chunks of a source whose heads are combined in one task; the ranges' summaries are combined after them.
CARRY_CHUNKS = 1024
#: Consecutive seq values of a bucket in the search for the lines that follow a few anchors.
BUCKET_ROWS = 4096


def starts_event() -> Column:
    """True for a row that ends the context of the event before it."""
    return (F.col("level") != "unknown") | is_blank(F.col("payload"))


def _cut(lines: Column, n: int) -> Column:
    """Lines (of struct<kind,line>) up to the first one that starts an event."""
    stop = F.array_position(F.transform(lines["kind"], lambda k: k.bitwiseAND(_BREAK)), _BREAK)
    return F.slice(lines["line"], F.lit(1), F.when(stop > 0, stop - 1).otherwise(n).cast("int"))


def _is_closed(lines: Column, n: int) -> Column:
    return (F.size(lines) >= n) | F.exists(lines["kind"], lambda k: k.bitwiseAND(_BREAK) == _BREAK)


def _with_gaps(lines: Column, at: Column, gap: Column) -> Column:
    """Lines of struct<kind,line,at>, of which those more than ``gap`` after the one before them start an event."""
    def kind(x: Column, i: Column) -> Column:
        before = F.when(i == 0, at).otherwise(F.get(lines, i - 1)["at"])
        return x["kind"].bitwiseOR(F.when(x["at"] > before + gap, F.lit(_BREAK)).otherwise(F.lit(0)))

    return F.transform(lines, lambda x, i: F.struct(kind(x, i).alias("kind"), x["line"].alias("line"), x["at"].alias("at")))


def _until_break(lines: Column, n: int) -> Column:
    """The first ``n`` lines up to the first one that starts an event, that one included."""
    stop = F.array_position(F.transform(lines["kind"], lambda k: k.bitwiseAND(_BREAK)), _BREAK)
    return F.slice(lines, F.lit(1), F.when(stop > 0, F.least(stop, F.lit(n))).otherwise(n).cast("int"))


def _following(lists: Column, n: int) -> Column:
    """Several heads as one. Joining heads is associative: what stands after a break, or beyond ``n`` lines, never matters."""
    return _until_break(F.flatten(lists), n)


def _carries(heads: DataFrame, n: int, range_chunks: int) -> DataFrame:
    """``source, chunk, carry``: the first lines of the chunks after each, from ``source, chunk, head``.

    Two levels of a prefix combination, so that no task sees more than ``range_chunks`` heads of a hot source:
    heads are combined within ranges of chunks, each range is summed up as one head, and these are combined in turn.
    """
    heads = heads.withColumn("range", F.floor(F.col("chunk") / range_chunks))
    in_range = Window.partitionBy("source", "range").orderBy("chunk")
    after, upto = in_range.rowsBetween(1, n), in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # each later chunk gives at least one row, so n chunks are enough
    near = heads.withColumn("later", F.collect_list("head").over(after)).withColumn("place", F.count(F.lit(1)).over(upto))
    near = near.select("source", "chunk", "range", "head", _following(F.col("later"), n).alias("near"), "place")
    ranges = near.where(F.col("place") <= n).groupBy("source", "range").agg(
        _following(F.transform(F.array_sort(F.collect_list(F.struct("place", "head"))), lambda x: x["head"]), n).alias("whole")
    )
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(1, n)
    far = ranges.withColumn("later", F.collect_list("whole").over(by_range)).select(
        F.col("source").alias("of"), F.col("range").alias("at"), _following(F.col("later"), n).alias("far")
    )
    # every range has its row; a left join adds no filter that would keep the log's exchange from being shared
    joined = near.join(far, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")), "left")
    return joined.select("source", "chunk", _following(F.array("near", "far"), n).alias("carry"))


def trailing_context(
    logs: DataFrame,
    n: int = DEFAULT_CONTEXT_LINES,
    anchors: Column | None = None,
    max_payload_chars: int = DEFAULT_PAYLOAD_CHARS,
    chunk_rows: int = CHUNK_ROWS,
    carry_chunks: int = CARRY_CHUNKS,
    gap: str | None = None,
) -> DataFrame:
    """Context of every anchor row (all rows by default): ``seq, source, context, closed``.

    ``closed`` says that no later row can add to the context. With ``gap`` (an interval, say "30 SECONDS") a row that comes
    more than that after the row of its source before it belongs to no context either, and ``open_until`` gives the
    time from which on no row can add to the context; a row without a time makes no gap and leaves that open (null).

    The log is grouped by source *and* chunk, so one hot source is spread over many tasks.
    What an anchor near the end of a chunk still lacks is the head (first ``n`` rows) of the
    chunks that follow; heads are few, and are handed back per chunk, in ranges of ``carry_chunks``
    chunks. The rows are shuffled once: both uses read the same exchange.
    """
    anchors = F.lit(True) if anchors is None else anchors
    kind = F.when(starts_event(), F.lit(_BREAK)).otherwise(F.lit(0)) + F.when(anchors, F.lit(_ANCHOR)).otherwise(
        F.lit(0)
    )
    # a row that starts an event is never anybody's context, so its text stays behind
    line = F.when(~starts_event(), elide(F.col("payload"), max_payload_chars)[0])
    # exactly these columns go through the exchange, whichever of the two uses reads it
    narrow = logs.select(
        "seq", "source", chunk_of(F.col("seq"), chunk_rows).alias("chunk"),
        F.struct(kind.alias("kind"), line.alias("line"), *([F.col("timestamp").alias("at")] if gap else [])).alias("item"),
    )
    is_anchor = F.col("item.kind").bitwiseAND(_ANCHOR) == _ANCHOR
    if n == 0:
        empty = F.array().cast("array<string>")
        until = [F.col("item.at").alias("open_until")] if gap else []
        return narrow.where(is_anchor).select("seq", "source", empty.alias("context"), F.lit(True).alias("closed"), *until)

    by_seq = Window.partitionBy("source", "chunk").orderBy("seq")
    rows = narrow.withColumn("lines", F.collect_list("item").over(by_seq.rowsBetween(1, n))).where(is_anchor)

    # count(*) rather than row_number(): a ranking filter would be pushed below the exchange,
    # which would then no longer be shared
    position = F.count(F.lit(1)).over(by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heads = (
        narrow.withColumn("position", position)
        .where(F.col("position") <= n)
        .groupBy("source", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("head"))
        .select("source", "chunk", _until_break(F.col("head.item"), n).alias("head"))
    )
    carries = _carries(heads, n, carry_chunks)
    none = F.array().cast(carries.schema["carry"].dataType)
    lines, until = F.slice(F.concat("lines", F.coalesce("carry", none)), 1, n), []
    if gap:
        length = F.expr(f"INTERVAL {gap}")
        lines = _with_gaps(lines, F.col("item.at"), length)
        own = F.size(_cut(F.col("lines"), n))
        until = [(F.when(own == 0, F.col("item.at")).otherwise(F.get(F.col("lines"), own - 1)["at"]) + length).alias("open_until")]
    carries = carries.select(F.col("source").alias("of"), F.col("chunk").alias("at"), "carry")
    return (
        # rows without a source have contexts too
        rows.join(carries, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")), "left")
        .withColumn("lines", lines)
        .select(
            "seq",
            "source",
            _cut(F.col("lines"), n).alias("context"),
            _is_closed(F.col("lines"), n).alias("closed"),
            *until,
        )
    )


def context_of(
    logs: DataFrame,
    anchors: DataFrame,
    n: int = DEFAULT_CONTEXT_LINES,
    max_payload_chars: int = DEFAULT_PAYLOAD_CHARS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Text and context of a few rows: ``seq, sample, context`` for each ``(seq, source)`` of ``anchors``.

    ``anchors`` must be small and bounded (at most ``MAX_LIMIT`` rows, seq unique): it is
    broadcast. Rows older than the oldest anchor are not read. The lines that follow an anchor are looked
    for by an equi-join on source and bucket of seq values, in the anchor's bucket and the next, so a log row is tested
    against the anchors near it alone. Anchors whose context is not complete there belong to sources with few
    rows; theirs is looked for among all later rows of these sources. Runs one job: what is near is staged.
    """
    if not n:
        own = anchors.select("seq")
        text = logs.where(F.col("seq") >= anchors.agg(F.min("seq")).scalar()).join(F.broadcast(own), "seq")
        return text.select("seq", elide(F.col("payload"), max_payload_chars)[0].alias("sample"), F.array().cast("array<string>").alias("context"))
    oldest_anchor = anchors.agg(F.min("seq")).scalar()
    rows = logs.where(F.col("seq") >= oldest_anchor).select(
        "seq", "source", F.when(starts_event(), F.lit(_BREAK)).otherwise(F.lit(0)).alias("kind"),
        elide(F.col("payload"), max_payload_chars)[0].alias("line"),
    )
    bucket = chunk_of(F.col("seq"), bucket_rows)
    wanted = anchors.select(F.col("source").alias("of"), F.col("seq").alias("anchor"))
    spread = wanted.withColumn("at", F.explode(F.array(chunk_of(F.col("anchor"), bucket_rows), chunk_of(F.col("anchor"), bucket_rows) + 1)))
    near = rows.join(
        F.broadcast(spread), (bucket == F.col("at")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("seq") >= F.col("anchor"))
    )
    found = stage(_first_lines(near, n))
    missing = found.where(~F.col("closed")).select(F.col("source").alias("of"), F.col("seq").alias("anchor"))
    far = rows.join(F.broadcast(missing), F.col("source").eqNullSafe(F.col("of")) & (F.col("seq") >= F.col("anchor")))
    every = found.where("closed").unionByName(_first_lines(far, n))
    return every.select("seq", "sample", _cut(F.col("lines"), n).alias("context"))


def _first_lines(pairs: DataFrame, n: int) -> DataFrame:
    """``seq, source, sample, lines, closed`` of each anchor from pairs of it and later rows of its source, itself included.

    The ranking limit applies before the shuffle, so at most ``n + 1`` rows per anchor and task move.
    """
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy("seq"))).where(F.col("r") <= n + 1)
    grouped = ranked.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("seq", "source", "kind", "line"))).alias("all"))
    lines = F.transform(F.slice("all", 2, n), lambda x: F.struct(x["kind"].alias("kind"), x["line"].alias("line")))
    first = F.get(F.col("all"), F.lit(0))
    return grouped.select(F.col("anchor").alias("seq"), first["source"].alias("source"), first["line"].alias("sample"), lines.alias("lines")).withColumn(
        "closed", _is_closed(F.col("lines"), n)
    )
