"""Readers that turn text into log records: files, containers, captured output, any line stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.levels import detect_level
from ..functions.text import strip_line_ending
from ..functions.timeparse import instant_literal
from ..session import prepare

# Where a line stood in its file. Together these give the arrival order of lines read at the same time.
# A streaming plan cannot number lines; there the id is added to each micro-batch when it is appended.
# Older files come first; of a rotated set that was written at one time, the higher suffix is the older one.
FILE_POSITION = ("file_time", "rotation", "file", "block_start")
LINE_ID = "line_id"
POSITION = (*FILE_POSITION, LINE_ID)


def from_lines(
    df: DataFrame,
    text_col: str,
    source: str | Column,
    ts_col: str | None = None,
    keep_empty: bool = False,
    kind: str = "lines",
    extra: tuple[str, ...] = (),
    positions: bool = False,
) -> DataFrame:
    """Log records of any batch or streaming DataFrame of lines under one label (or a label column).

    Without ``ts_col`` a record is stamped with the time it is read. Empty lines are dropped
    unless ``keep_empty`` (captured process output keeps them). ``positions`` adds the columns of
    ``POSITION``: the lines of a batch are numbered as the DataFrame holds them, those of a stream
    when their micro-batch is appended.
    """
    prepare(df.sparkSession)
    if positions:
        df = df.select(
            "*", F.lit(None).cast("timestamp").alias("file_time"), F.lit(0).alias("rotation"),
            F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("block_start"),
            *([] if df.isStreaming else [F.monotonically_increasing_id().alias(LINE_ID)]),
        )
        extra = (*extra, *FILE_POSITION, *(() if df.isStreaming else (LINE_ID,)))
    payload = strip_line_ending(F.col(text_col), kind)
    label = F.lit(source) if isinstance(source, str) else source
    records = df.select(
        (F.col(ts_col) if ts_col else F.current_timestamp()).alias("timestamp"),
        label.alias("source"),
        payload.alias("payload"),
        *extra,
    )
    if not keep_empty:
        records = records.where(F.col("payload") != "")
    return records.select("timestamp", "source", detect_level(F.col("payload")).alias("level"), "payload", *extra)


def read_lines(
    spark: SparkSession,
    path: str | list[str],
    label: str | Column | None = None,
    stream: bool = False,
    newer_than: datetime | None = None,
    kind: str = "file",
    keep_empty: bool = False,
    positions: bool = False,
) -> DataFrame:
    """Log records of text files; the label is the file name unless given.

    ``stream=True`` follows a folder (or glob) and picks up every file that appears there,
    each once; give it closed files, because an unterminated last line counts as a line.
    ``newer_than`` leaves out files last changed before that time. Lines end at ``\\n`` only.
    ``positions`` adds the columns of ``POSITION``, which order lines that were read together.
    """
    reader = spark.readStream if stream else spark.read
    files = reader.format("text").option("lineSep", "\n")
    files = files.load(path) if stream or isinstance(path, str) else files.load(list(path))
    if newer_than is not None:
        files = files.where(F.col("_metadata.file_modification_time") > instant_literal(newer_than))
    lines = files.select(
        "value",
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        (-F.coalesce(F.regexp_extract("_metadata.file_name", r"\.(\d{1,9})$", 1).try_cast("int"), F.lit(0))).alias("rotation"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    extra = FILE_POSITION if positions else ()
    if positions and not stream:
        lines, extra = lines.withColumn(LINE_ID, F.monotonically_increasing_id()), POSITION
    source = F.col("file_name") if label is None else label
    return from_lines(lines, "value", source, None, keep_empty, kind, extra)


def container_name() -> Column:
    """Container name from the name of its log file: no leading slash, no ``.log`` or rotation suffix."""
    return F.regexp_replace(F.ltrim(F.col("file_name"), F.lit("/")), r"(\.log)?(\.\d+)?$", "")


def read_containers(
    spark: SparkSession, path: str, tail: int | None = None, stream: bool = False, positions: bool = True
) -> DataFrame:
    """Log records of a folder of container logs, one file per container and its rotated predecessors.

    All lines are read; ``tail`` keeps the last lines of every container, the newest file's first (batch only).
    """
    if stream and tail is not None:
        raise ValueError("`tail` is for batch reads; a stream takes every line of its files")
    records = read_lines(spark, path, container_name(), stream, kind="container", positions=positions or tail is not None)
    if tail is None:
        return records
    # the ranking limit applies before the shuffle, so at most `tail` rows per container and split move
    newest_first = Window.partitionBy("source").orderBy(*[F.col(c).desc() for c in POSITION])
    return records.withColumn("r", F.row_number().over(newest_first)).where(F.col("r") <= tail).drop("r")


def read_process_output(
    spark: SparkSession, path: str | list[str], label: str, stream: bool = False, positions: bool = True
) -> DataFrame:
    """Log records of a process's captured output; empty lines are kept."""
    return read_lines(spark, path, label, stream, kind="lines", keep_empty=True, positions=positions)
