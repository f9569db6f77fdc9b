from __future__ import annotations

import json
import threading
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from logevidence.operators import error_groups, filter_logs, source_stats, trailing_context
from logevidence.schema import LOG_SCHEMA
from logevidence.session import stage
from logevidence.sources import append_batch, read_log_table
from logevidence.streaming import (
    follow_to, follow_traces, hydrate_and_follow, open_traces, read_after, read_traces, read_unique,
    running_error_groups, running_source_stats, unique_by_seq, wait_for_logs,
)
from tests.conftest import FLOOD
from tests.test_operators import random_log


@pytest.fixture
def table(spark, make_logs, tmp_path):
    """A log table holding the flood, and a function that appends more batches."""
    path, count = str(tmp_path / "log"), [0]

    def append(*rows):
        records = make_logs(rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        append_batch(records, path, "t", count[0], order_by=("seq",))
        count[0] += 1

    append(*FLOOD)
    return path, append


def run(query):
    query.awaitTermination()


def later(seconds, function, *args):
    thread = threading.Thread(target=lambda: (time.sleep(seconds), function(*args)))
    thread.start()
    return thread


def test_follow(spark, table, tmp_path):
    path, append = table
    out = str(tmp_path / "out")
    for _ in range(2):
        run(follow_to(read_log_table(spark, path, stream=True), out, str(tmp_path / "cp"), {"availableNow": True}, grep="quota|new"))
        append(("api", "error", "ERROR new"))
    got = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert len(got) == 31 and {"seq", "timestamp", "source", "level", "payload"} == set(got[0])


def complete(spark, df, tmp_path, name):
    rows = df.writeStream.format("memory").queryName(name).outputMode("complete")
    run(rows.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    return spark.table(name)


def test_running_aggregates_equal_the_batch_answer(spark, table, tmp_path):
    path, append = table
    append(("web", "warn", "slow"), ("api", "error", "ERROR quota spent: bucket:1"))
    batch, stream = read_log_table(spark, path), read_log_table(spark, path, stream=True)
    stats = complete(spark, running_source_stats(stream), tmp_path, "running_stats")
    assert sorted(stats.collect()) == sorted(source_stats(batch).collect())
    groups = complete(spark, running_error_groups(filter_logs(stream, level="error")), tmp_path, "running_groups")
    columns = ["fingerprint", "count", "level", "first_seen", "last_seen", "first_seq", "last_seq"]
    want = error_groups(filter_logs(batch, level="error")).select(*columns).collect()
    assert groups.select(*columns).collect() == want and groups.first()["sample"].endswith("bucket:1")


@pytest.mark.parametrize("sizes", [[400], [1, 3, 50, 46, 300], [40] * 10])
def test_traces_equal_the_batch_context(spark, make_logs, tmp_path, sizes):
    from logevidence.streaming.traces import trace_batch

    logs, _ = random_log(make_logs, seed=21)
    logs = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    anchors = F.col("level") == "error"
    path, start = str(tmp_path / "traces"), 0
    for i, size in enumerate(sizes):
        batch = logs.where((F.col("seq") > start) & (F.col("seq") <= start + size))
        for _ in range(2 if i == 1 else 1):  # a replay changes nothing
            trace_batch(batch, path, i, anchors, 3, chunk_rows=16)
        start += size
    got = {r["seq"]: r["context"] for r in read_traces(spark, path).collect()}
    still_open = {r["seq"]: r["context"] for r in open_traces(spark, path, len(sizes) - 1, anchors, 3).collect()}
    assert not got.keys() & still_open.keys()
    want = {r["seq"]: r["context"] for r in trailing_context(logs, 3, anchors).collect()}
    assert got | still_open == want


@pytest.mark.parametrize("sizes", [[400], [1, 3, 50, 46, 300], [40] * 10])
def test_traces_with_a_timeout(spark, make_logs, tmp_path, sizes):
    """An event of a silent source closes; a line after the gap belongs to nobody, in whatever batch it comes."""
    from logevidence.streaming.traces import trace_batch

    logs, _ = random_log(make_logs, seed=22)
    times = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 10 + F.floor(F.col("seq") / 37) * 300)
    logs = stage(logs.withColumn("timestamp", times))
    anchors, path, start = F.col("level") == "error", str(tmp_path / "traces"), 0
    for i, size in enumerate(sizes):
        batch = logs.where((F.col("seq") > start) & (F.col("seq") <= start + size))
        for _ in range(2 if i == 1 else 1):
            trace_batch(batch, path, i, anchors, 3, chunk_rows=16, timeout="120 SECONDS")
        start += size
    got = {r["seq"]: list(r["context"]) for r in read_traces(spark, path).collect()}
    still_open = {r["seq"]: list(r["context"]) for r in open_traces(spark, path, len(sizes) - 1, anchors, 3, "120 SECONDS").collect()}
    rows, want, until = logs.orderBy("seq").collect(), {}, {}
    for i, row in enumerate(rows):
        if row["level"] == "error":
            lines, last = [], row["timestamp"]
            for x in (x for x in rows[i + 1 :] if x["source"] == row["source"]):
                if x["level"] != "unknown" or not x["payload"].strip() or (x["timestamp"] - last).total_seconds() > 120 or len(lines) == 3:
                    break
                lines.append(x["payload"])
                last = x["timestamp"]
            want[row["seq"]], until[row["seq"]] = lines, last
    assert not got.keys() & still_open.keys() and got | still_open == want
    assert all((rows[-1]["timestamp"] - until[seq]).total_seconds() <= 120 for seq in still_open)


def test_follow_unique_lets_no_repeat_pass(spark, make_logs, tmp_path):
    from logevidence.streaming.unique import _seen, unique_batch

    logs = stage(random_log(make_logs, seed=23)[0])
    path = str(tmp_path / "unique")
    parts = ["seq % 2 = 0", "seq <= 100", "seq > 250 OR seq % 9 = 0", "seq > 0", "seq % 2 = 0"]
    for i, part in enumerate(parts):
        for _ in range(2 if i == 2 else 1):  # a replay changes nothing
            unique_batch(logs.where(part).unionByName(logs.where(part).limit(5)), path, i, chunk_rows=64)
    assert sorted(r["seq"] for r in read_unique(spark, path).collect()) == [r["seq"] for r in logs.orderBy("seq").collect()]
    ranges = _seen(spark, path, len(parts))
    assert ranges.count() == ranges.select("chunk").distinct().count()  # dense numbers are one range per chunk
    unnumbered = logs.limit(2).withColumn("seq", F.lit(None).cast("bigint"))
    unique_batch(unnumbered, path, len(parts), chunk_rows=64)
    assert read_unique(spark, path).where("seq IS NULL").count() == 2
    unique_batch(logs.limit(0), path, len(parts) + 1, chunk_rows=64)
    assert _seen(spark, path, len(parts) + 2).count() == ranges.count()


def test_a_batch_rewrites_its_own_ranges_and_few_others(spark, make_logs, tmp_path):
    from logevidence.streaming.unique import RANGES, _seen, unique_batch

    logs = stage(random_log(make_logs, seed=29)[0].where("seq <= 240"))
    path = str(tmp_path / "unique")
    kept = []
    for i in range(6):
        # every second number of forty, those of the batch before again
        unique_batch(logs.where(f"seq % 2 = 0 AND seq > {40 * (i - 1)} AND seq <= {40 * (i + 1)}"), path, i, chunk_rows=16)
        kept.append(spark.read.schema(RANGES).parquet(f"{path}/_seen/batch={i}").count())
    assert kept == [20, 40, 20, 80, 20, 40]
    even = [r["seq"] for r in logs.where("seq % 2 = 0").orderBy("seq").collect()]
    assert sorted(r["seq"] for r in read_unique(spark, path).collect()) == even == list(range(2, 241, 2))
    assert sorted((r["first"], r["last"]) for r in _seen(spark, path, 6).collect()) == [(n, n) for n in even]


def test_follow_traces_on_the_table(spark, table, tmp_path):
    path, append = table
    append(("api", "info", "next"), ("web", "error", "ERROR open"), ("web", "unknown", "    at x"))
    stream = read_log_table(spark, path, stream=True)
    run(follow_traces(stream, str(tmp_path / "t"), str(tmp_path / "cp"), F.col("level") == "error", availableNow=True))
    contexts = [list(r["context"]) for r in read_traces(spark, str(tmp_path / "t")).orderBy("seq").collect()]
    assert contexts == [[]] * 29 + [["    at Writer.flush (store.js:17)"]]
    with pytest.raises(ValueError):
        follow_traces(stream, str(tmp_path / "t"), str(tmp_path / "cp"), F.col("level") == "error", n=0)


def test_hydrate_and_follow_sees_everything_once(spark, table, tmp_path):
    path, append = table
    append(("api", "info", "during"))
    query, view = hydrate_and_follow(
        lambda: read_log_table(spark, path), read_log_table(spark, path, stream=True), str(tmp_path / "live"),
        str(tmp_path / "cp"), availableNow=True,
    )
    run(query)
    append(("api", "info", "after"))
    assert sorted(r["seq"] for r in view().collect()) == list(range(1, 35))


def test_history_alone_while_nothing_is_live(spark, table, tmp_path):
    path, _ = table
    (tmp_path / "quiet").mkdir()
    stream = spark.readStream.schema(LOG_SCHEMA).parquet(str(tmp_path / "quiet"))
    query, view = hydrate_and_follow(
        lambda: read_log_table(spark, path), stream, str(tmp_path / "live"), str(tmp_path / "cp"), availableNow=True
    )
    run(query)
    assert view().count() == 32


def test_unique_by_seq(spark, make_logs, tmp_path):
    rows = make_logs(FLOOD).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows.unionByName(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = unique_by_seq(spark.readStream.schema(LOG_SCHEMA).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("unique_rows").trigger(availableNow=True)
    run(query.option("checkpointLocation", str(tmp_path / "cp")).start())
    assert spark.table("unique_rows").count() == 32


def test_incremental_reads(spark, table):
    path, append = table
    first = read_after(read_log_table(spark, path), 0)
    cursor = first.envelope.first()["next_cursor"]
    assert first.rows.count() == 32 and cursor == 32
    append(("api", "error", "ERROR a"), ("api", "info", "b"))
    step = read_after(read_log_table(spark, path), cursor)
    assert [r["seq"] for r in step.rows.collect()] == [33, 34] and not step.envelope.first()["cursor_gap"]
    assert read_after(read_log_table(spark, path), cursor, level="error").rows.count() == 1
    assert read_after(read_log_table(spark, path), 99).envelope.first()["cursor_gap"]


# wait


def test_wait_answers_from_the_buffer(spark, table):
    path, _ = table
    answer = wait_for_logs(lambda: read_log_table(spark, path), grep="bundle", timeout_ms=60_000, limit=5)
    env = answer.envelope.first()
    assert env["matched"] and env["matched_from_buffer"] and env["waited_ms"] == 0
    assert [r["seq"] for r in answer.rows.collect()] == [1, 2, 3, 4, 5]
    assert (env["total_matching"], env["truncated"]) == (32, True)


@pytest.mark.parametrize("streamed", [False, True])
def test_wait_sees_a_new_line_and_answers_with_the_burst(spark, table, streamed):
    path, append = table
    thread = later(
        2, append, ("web", "error", "ERROR bundle broken"), ("web", "unknown", "    at deploy.js"), ("api", "info", "stopped")
    )
    stream = read_log_table(spark, path, stream=True) if streamed else None
    answer = wait_for_logs(
        partial(read_log_table, spark, path), stream, grep="bundle", require_new=True, timeout_ms=60_000, settle_ms=50
    )
    thread.join()
    env = answer.envelope.first()
    assert env["matched"] and not env["matched_from_buffer"] and env["waited_ms"] > 0
    assert [r["payload"] for r in answer.rows.collect()] == ["ERROR bundle broken", "    at deploy.js", "stopped"]


@pytest.mark.parametrize("streamed", [False, True])
def test_wait_times_out_without_claiming_a_match(spark, table, streamed):
    path, _ = table
    stream = read_log_table(spark, path, stream=True) if streamed else None
    answer = wait_for_logs(
        lambda: read_log_table(spark, path), stream, grep="bundle", require_new=True, cursor=999_999, timeout_ms=1500
    )
    env = answer.envelope.first()
    assert not env["matched"] and not env["matched_from_buffer"] and env["waited_ms"] >= 1500
    assert env["cursor_gap"] and env["buffer_start_cursor"] == 1 and env["next_cursor"] == 32
    assert answer.rows.count() == 0


@pytest.mark.parametrize("bad", [{"grep": "[[[bad"}, {"level": "loud"}, {"require_new": "yes please"}, {"timeout_ms": -1}, {"timeout_ms": 120_001}])
def test_wait_rejects_bad_arguments_at_once(spark, table, bad):
    path, _ = table
    with pytest.raises(ValueError, match=next(iter(bad))):
        wait_for_logs(lambda: read_log_table(spark, path), timeout_ms=bad.pop("timeout_ms", 120_000), **bad)
