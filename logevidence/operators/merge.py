"""Union of sources, and union of history with live rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from .order import retain_newest


def merge_sources(*frames: DataFrame) -> DataFrame:
    """One timeline of several labelled sources, batch or streaming."""
    if not frames:
        raise ValueError("no sources to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_by_seq(history: DataFrame, *later: DataFrame, keep: int | None = None) -> DataFrame:
    """History and later batches as one log; where a seq occurs twice the later batch wins.

    Rows of the (large) history are only filtered by an anti-join on ``seq``, never regrouped.
    ``history`` is a retained log and holds each seq once; a later batch may repeat rows.
    ``keep`` then retains the newest rows; by default all stay.
    """
    merged = history
    for batch in later:
        batch = batch.dropDuplicates(["seq"])
        merged = merged.join(batch.select("seq"), "seq", "left_anti").select(*history.columns).unionByName(batch)
    return merged if keep is None else retain_newest(merged, keep)
