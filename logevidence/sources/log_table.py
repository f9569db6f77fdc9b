"""The retained log: a Parquet table of sequenced records that batches are appended to.

Layout: ``<path>/stream=<id>/batch=<n>/*.parquet`` holds batches as they came, each in a folder that is written once;
``<path>/_merged/<id>/*.parquet`` what a compaction made of several; ``<path>/_versions/<n>.json`` which of them are live (see
`manifest`); ``<path>/_summaries`` counters of each of them (see `summaries`); ``<path>/_grams`` what their files can be searched
for (see `grams`). A batch is part of the table once a version names it, so a batch that is repeated after a failure is seen once.
Seq rises with the batches, so file and row-group statistics on ``seq`` and ``timestamp`` let readers skip what lies outside a
cursor or a time range. One writer appends at a time; compaction, eviction and readers may run beside it.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import check_pattern, payload_matches
from ..operators.order import assign_seq, retain_newest
from ..schema import CHUNK_ROWS, LOG_SCHEMA
from ..session import unstage
from .grams import Opened, files_that_may_match, grams_of
from .lines import FILE_POSITION, LINE_ID
from .manifest import TableFiles, Version, at_version, latest, publish
from .summaries import summary_of, write_summary

_TABLE_SCHEMA = T.StructType(
    [*LOG_SCHEMA.fields, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())]
)
_COLUMNS = [f.name for f in LOG_SCHEMA.fields]


def read_log_table(
    spark: SparkSession, path: str, stream: bool = False, version: int | None = None, after: int | None = None,
    grep: str | None = None,
) -> DataFrame:
    """The retained log as of its newest version, or of an older one that `vacuum` has not removed.

    ``after`` leaves out rows up to that seq, and does not even look into folders that hold no newer ones. ``grep`` leaves out
    rows whose payload the pattern is not found in, and does not open files that `index_grams` knows to hold no match.

    ``stream=True`` follows the table: every appended batch arrives once, whatever compaction and eviction
    do meanwhile; a follower must read a batch before `vacuum` removes it.
    """
    matches = None if grep is None else payload_matches(check_pattern(grep))
    if stream:
        rows = spark.readStream.schema(_TABLE_SCHEMA).parquet(path).select(*_COLUMNS)
        return rows if matches is None else rows.where(matches)
    files = TableFiles(spark, path)
    now = latest(files) if version is None else at_version(files, version)
    now = now if after is None else _after(now, after)
    if now.number and matches is not None:
        return _rows(files, now, files_that_may_match(files, now.folders, grep)).where(matches)
    if now.number:
        return _rows(files, now)
    if matches is not None:
        return read_log_table(spark, path, after=after).where(matches)
    try:
        rows = spark.read.schema(_TABLE_SCHEMA).parquet(path).select(*_COLUMNS)  # written without versions
        return rows if after is None else rows.where(F.col("seq") > after)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)  # nothing was ever written


def _after(version: Version, seq: int) -> Version:
    """A version without the rows up to ``seq``."""
    floor = max(version.floor, seq)
    return replace(version, floor=floor, folders=tuple(f for f in version.folders if f.last > floor))


def _rows(files: TableFiles, version: Version, opened: Opened | None = None) -> DataFrame:
    """The rows of a version, or of what is opened of its folders and files."""
    spark, opened = files.spark, opened or Opened([f.name for f in version.folders])
    read = lambda names: spark.read.schema(LOG_SCHEMA).parquet(*(f"{files.path}/{name}" for name in names))
    parts = [read(opened.paths)] if opened.paths else []
    if opened.folders:
        parts.append(read(opened.folders).where(opened.kept))
    if not parts:
        return spark.createDataFrame([], LOG_SCHEMA)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where(F.col("seq") > version.floor) if version.floor else rows


def append_batch(
    batch: DataFrame, path: str, stream_id: str = "manual", batch_id: int = 0, order_by: tuple[str | Column, ...] = ()
) -> int:
    """Number the records of one batch in arrival order and append them; returns the table's highest seq.

    The order is ``order_by``, else the position columns of `read_lines` (time read, then age of the
    file, file and line); a batch that has neither is refused, since equal timestamps would leave
    its order to chance. When ``(stream_id, batch_id)`` comes again, what is there stands, so that readers
    of the table never see its rows twice, even if the batch has been compacted or evicted since.
    """
    spark, files = batch.sparkSession, TableFiles(batch.sparkSession, path)
    now = latest(files)
    if now.published(stream_id, batch_id):
        return now.last
    if not order_by:
        if not set(FILE_POSITION) <= set(batch.columns):
            raise ValueError("the batch has no position columns (`positions=True` of the readers): give `order_by`")
        if LINE_ID not in batch.columns:
            batch = batch.withColumn(LINE_ID, F.monotonically_increasing_id())
        order_by = ("timestamp", *FILE_POSITION, LINE_ID)
    if not now.number:
        now = _adopt(files)
    name = f"stream={stream_id}/batch={batch_id}"
    if not files.exists(f"{name}/_SUCCESS"):
        batch = batch.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        numbered = assign_seq(batch, *order_by, start=now.last + 1)
        numbered.select(*_COLUMNS).write.mode("overwrite").parquet(f"{files.path}/{name}")
        unstage(numbered)
    folder = write_summary(spark, files.path, name)
    return publish(files, lambda v: None if v.published(stream_id, batch_id) else v.with_batch(stream_id, batch_id, folder)).last


def _adopt(files: TableFiles) -> Version:
    """The first version of a table that was written without versions: all its finished batches."""
    found = [
        (stream, batch) for stream in files.names("") if stream.startswith("stream=")
        for batch in files.names(stream) if files.exists(f"{stream}/{batch}/_SUCCESS")
    ]
    if not found:
        return Version()
    version = Version()
    for stream, batch in sorted(found):
        id_, number = stream.removeprefix("stream="), int(batch.removeprefix("batch="))
        version = version.with_batch(id_, number, write_summary(files.spark, files.path, f"{stream}/{batch}"))
    return publish(files, lambda v: version if not v.number else None)


def append_logs(
    records: DataFrame,
    path: str,
    checkpoint: str,
    condition: Column | None = None,
    order_by: tuple[str | Column, ...] = (),
    **trigger,
) -> StreamingQuery:
    """Start the ingest of a stream of records into the retained log.

    ``condition`` filters before retention: what it drops never gets a seq. Exactly once:
    the checkpoint replays a failed batch under the same id, which finds its folder written.
    Trigger arguments go to ``writeStream.trigger`` (e.g. ``availableNow=True``).
    """
    stream_id = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    kept = records if condition is None else records.where(condition)
    writer = kept.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: append_batch(batch, path, stream_id, batch_id, order_by) and None
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def evict(spark: SparkSession, path: str, keep: int) -> int:
    """Retain only the newest ``keep`` rows; returns the highest seq that is gone.

    Nothing is rewritten: the new version says from which seq on rows count and drops the folders below it.
    """
    def change(now: Version) -> Version | None:
        then = _after(now, now.last - max(keep, 1))
        return None if then.floor == now.floor else then

    return publish(TableFiles(spark, path), change).floor


def compact_in_place(spark: SparkSession, path: str, rows_per_file: int = CHUNK_ROWS) -> Version:
    """Merge the live folders into one of few, seq-ordered files, and publish it in their place.

    Batches that are appended meanwhile stay as they are. If another compaction replaced one of
    the folders first, this one gives way and changes nothing.
    """
    files = TableFiles(spark, path)
    seen = latest(files)
    if len(seen.folders) < 2:
        return seen
    name, old = f"_merged/{uuid.uuid4().hex}", {f.name for f in seen.folders}
    _write_ordered(_rows(files, seen), f"{files.path}/{name}", rows_per_file)
    merged = write_summary(spark, files.path, name)

    def change(now: Version) -> Version | None:
        rest = tuple(f for f in now.folders if f.name not in old)
        # an eviction may have dropped folders meanwhile; a compaction would have brought in another merged one
        taken = any(f.name.startswith("_merged/") and f.name not in old for f in now.folders)
        return None if taken else replace(now, folders=((merged,) if merged.rows and merged.last > now.floor else ()) + rest)

    then = publish(files, change)
    if all(f.name != name for f in then.folders):
        _delete(files, name)
    return then


def vacuum(spark: SparkSession, path: str, grace_seconds: float) -> list[str]:
    """Delete folders that no version needs which was current within the time of grace; returns their names.

    The grace must exceed the longest query on the table and the furthest that a follower lags behind. Versions that
    were replaced before that time go too. Batches that are written but not published yet are kept.
    """
    files = TableFiles(spark, path)
    now, limit = latest(files), time.time() * 1000 - grace_seconds * 1000
    stamps = {int(n.removesuffix(".json")): t for n, t in files.names("_versions").items() if n.endswith(".json")}
    # a version was current until the next one came
    kept = [n for n in stamps if n == now.number or stamps.get(n + 1, limit) >= limit]
    needed = {f.name for n in kept for f in at_version(files, n).folders}
    gone = [f"_merged/{n}" for n, t in files.names("_merged").items() if t < limit]
    for stream in files.names(""):
        if stream.startswith("stream="):
            id_ = stream.removeprefix("stream=")
            gone += [f"{stream}/{b}" for b in files.names(stream) if now.published(id_, int(b.removeprefix("batch=")))]
    gone = sorted(n for n in gone if n not in needed)
    for name in gone:
        _delete(files, name)
    for number in set(stamps) - set(kept):
        files.delete(f"_versions/{number:012d}.json")
    return gone


def _delete(files: TableFiles, name: str) -> None:
    files.delete(name)
    files.delete(summary_of(name))
    files.delete(grams_of(name))


def _write_ordered(logs: DataFrame, target: str, rows_per_file: int) -> None:
    logs.repartitionByRange("seq").sortWithinPartitions("seq").write.option("maxRecordsPerFile", rows_per_file).parquet(target)


def compact(spark: SparkSession, path: str, target: str, keep: int | None = None, rows_per_file: int = CHUNK_ROWS) -> None:
    """Rewrite the log into another table, ``target``, as few, seq-ordered files, keeping only the newest ``keep`` rows."""
    logs = read_log_table(spark, path)
    logs = logs if keep is None else retain_newest(logs, keep, dense=True)
    _write_ordered(logs, f"{target}/stream=compacted/batch=0", rows_per_file)
    _adopt(TableFiles(spark, target))
