from __future__ import annotations

import os
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logevidence.functions import detect_level
from logevidence.operators import horizon, log_filter, source_stats, source_totals, status
from logevidence.operators.filters import check_pattern, payload_matches
from logevidence.plans import recent_errors, search_logs, search_table, table_horizon, table_source_stats, table_source_totals, table_status
from logevidence.session import staging_root
from logevidence.sources import (
    append_batch, append_logs, compact, compact_in_place, evict, from_lines, index_grams, parse_config, read_containers, read_lines, read_log_table, vacuum,
    read_counters, read_process_output, read_records, sources_from_config, write_records,
)
from logevidence.sources.manifest import TableFiles, publish
from logevidence.sources.lines import POSITION


def write(path, data: str):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data.encode())
    return str(path)


def rows(df):
    return sorted((r["source"], r["level"], r["payload"]) for r in df.collect())


def test_file_lines(spark, tmp_path):
    path = write(tmp_path / "app.log", "ERROR a\r\n\nline\rwith cr\n   \nlast")
    assert rows(read_lines(spark, path)) == [
        ("app.log", "error", "ERROR a"), ("app.log", "unknown", "   "), ("app.log", "unknown", "last"),
        ("app.log", "unknown", "line\rwith cr"),
    ]
    assert {r["source"] for r in read_lines(spark, path, "app").collect()} == {"app"}
    future = datetime(2100, 1, 1, tzinfo=timezone.utc)
    assert read_lines(spark, path, newer_than=future).count() == 0


def test_process_output_keeps_empty_lines(spark, tmp_path):
    path = write(tmp_path / "out.txt", "a\n\nb\n")
    assert rows(read_process_output(spark, path, "svc")) == [("svc", "unknown", x) for x in ("", "a", "b")]


def test_containers_start_with_their_last_lines(spark, tmp_path):
    write(tmp_path / "logs" / "web.log", "".join(f"w{i}\n" for i in range(120)))
    write(tmp_path / "logs" / "db.log", "d0\nd1\n")
    got = read_containers(spark, str(tmp_path / "logs" / "*"), tail=50)
    assert {r["payload"] for r in got.collect()} == {"d0", "d1"} | {f"w{i}" for i in range(70, 120)}
    assert {r["source"] for r in got.collect()} == {"web", "db"}
    assert read_containers(spark, str(tmp_path / "logs" / "*")).count() == 122


def test_the_tail_of_a_rotated_container_log_is_the_newest(spark, tmp_path):
    write(tmp_path / "logs" / "web.log.1", "".join(f"old {i}\n" for i in range(60)))
    write(tmp_path / "logs" / "web.log", "".join(f"new {i}\n" for i in range(60)))
    for stamp in ((100, 200), (150, 150)):  # by age, and by suffix where the age is the same
        for name, t in zip(("web.log.1", "web.log"), stamp):
            os.utime(tmp_path / "logs" / name, (t, t))
        got = read_containers(spark, str(tmp_path / "logs" / "*"), tail=50).collect()
        assert {r["payload"] for r in got} == {f"new {i}" for i in range(10, 60)}


def test_config_keeps_the_order_of_lines(spark, tmp_path):
    text = ["INFO begins", "ERROR breaks", "at Zed", "at Abe", "INFO ends"]
    file = write(tmp_path / "app.log", "\n".join(text))
    config = {"sources": {"file": [{"path": file, "label": "app"}], "stdin": "pipe"}}
    pipe = spark.createDataFrame([(t,) for t in text], "line string").coalesce(1)
    path = str(tmp_path / "log")
    append_batch(sources_from_config(spark, config, stdin_lines=pipe), path)
    got = read_log_table(spark, path).orderBy("seq").collect()
    assert [r["payload"] for r in got if r["source"] == "app"] == text == [r["payload"] for r in got if r["source"] == "pipe"]
    assert recent_errors(read_log_table(spark, path), source="app").rows.first()["context"] == ["at Zed", "at Abe"]


def test_a_batch_without_positions_is_refused(spark, tmp_path):
    lines = from_lines(spark.createDataFrame([("b",), ("a",)], "t string").coalesce(1), "t", "s")
    with pytest.raises(ValueError, match="order_by"):
        append_batch(lines, str(tmp_path / "log"))
    assert append_batch(lines, str(tmp_path / "log"), order_by=("payload",)) == 2


def test_rotated_files_are_numbered_by_age(spark, tmp_path):
    for age, name in enumerate(("app.log.2", "app.log.1", "app.log")):
        file = write(tmp_path / "in" / name, f"{name} a\n{name} b\n")
        os.utime(file, (1000 + age, 1000 + age))
    path = str(tmp_path / "log")
    append_batch(read_lines(spark, str(tmp_path / "in"), "app", positions=True), path)
    got = [r["payload"] for r in read_log_table(spark, path).orderBy("seq").collect()]
    assert got == [f"app.log{s} {c}" for s in (".2", ".1", "") for c in "ab"]


def test_a_repeated_batch_is_not_written_again(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = spark.createDataFrame([("x",), ("y",)], "t string")
    for _ in range(2):
        assert append_batch(from_lines(lines, "t", "s", positions=True), path, "q", 0) == 2
    version = tmp_path / "log" / "_versions" / "000000000001.json"
    version.rename(version.with_name("gone"))  # the data was written, the version was not
    assert append_batch(from_lines(lines, "t", "s", positions=True), path, "q", 0) == 2
    query = read_log_table(spark, path, stream=True).writeStream.format("memory").queryName("seen_once")
    query.trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen_once").count() == 2


def test_malformed_records_are_reported(spark, tmp_path):
    path = write(tmp_path / "r.json", '{"seq":1,"payload":"a"}\n{"seq":broken\n{"seq":2,"payload":"b"}\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read_records(spark, path).collect()
    kept = read_records(spark, path, malformed="keep").cache()
    assert [r["rejected"] for r in kept.where("rejected IS NOT NULL").collect()] == ['{"seq":broken']
    assert kept.count() == 3 and read_records(spark, path, malformed="skip").count() == 2


def test_any_lines(spark):
    df = spark.createDataFrame([("WARN x\n", "a"), ("", "b"), ("y", "c")], "t string, s string")
    assert rows(from_lines(df, "t", "pipe")) == [("pipe", "unknown", "y"), ("pipe", "warn", "WARN x")]
    assert rows(from_lines(df, "t", F.col("s"), keep_empty=True))[1] == ("b", "unknown", "")


CONFIG = """
[sources]
docker = true
stdin = "pipe"
[[sources.file]]
path = "{file}"
label = "app"
[[sources.process]]
label = "svc"
cmd = "run me"
restart = "on-failure"
"""


def test_config(spark, tmp_path):
    file = write(tmp_path / "app.log", "one\n")
    write(tmp_path / "c" / "box.log", "two\n")
    out = write(tmp_path / "svc.out", "three\n")
    config = parse_config(CONFIG.format(file=file))
    lines = spark.createDataFrame([("four",)], "line string")
    merged = sources_from_config(
        spark, config, container_logs=str(tmp_path / "c"), process_output={"svc": out}, stdin_lines=lines
    )
    assert [(r[0], r[2]) for r in rows(merged)] == [("app", "one"), ("box", "two"), ("pipe", "four"), ("svc", "three")]
    assert sources_from_config(spark, {}) is None
    with pytest.raises(ValueError, match="process_output"):
        sources_from_config(spark, config, container_logs=str(tmp_path / "c"), stdin_lines=lines)


@pytest.mark.parametrize(
    "bad", ["not toml [", "[[sources.file]]\nlabel = 'x'", "[sources]\ndocker = 'yes'",
            "[[sources.process]]\nlabel='a'\ncmd='b'\nrestart='sometimes'"],
)
def test_bad_config(bad):
    with pytest.raises(ValueError):
        parse_config(bad)


def test_records_round_trip(spark, make_logs, tmp_path):
    logs = make_logs([("a", "info", 'quote " and \n newline'), ("b", "error", "é")])
    path = str(tmp_path / "records")
    write_records(logs, path)
    back = read_records(spark, path).orderBy("seq").collect()
    want = logs.orderBy("seq").collect()
    assert [(r["seq"], r["source"], r["level"], r["payload"], r["payload_truncated_from"]) for r in back] == [
        (r["seq"], r["source"], r["level"], r["payload"], None) for r in want
    ]
    assert [r["timestamp"] for r in back] == [r["timestamp"] for r in want]


# the log table


def test_batches_are_numbered_and_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_log_table(spark, path).count() == 0
    def batch(*texts):
        return from_lines(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "s", positions=True)
    assert append_batch(batch("a", "b"), path, "x", 0) == 2
    assert append_batch(batch(), path, "x", 1) == 2
    assert append_batch(batch("c"), path, "x", 2) == 3
    assert append_batch(batch("c"), path, "x", 2) == 3  # replay
    assert append_batch(batch("d"), path, "y", 0) == 4  # another stream goes on after it
    got = {(r["seq"], r["payload"]) for r in read_log_table(spark, path).collect()}
    assert got == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}


def test_stream_ingest_of_rotated_files(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "cp")
    condition = log_filter(grep="keep")

    def ingest():
        stream = read_lines(spark, str(folder), "app", stream=True, positions=True)
        append_logs(stream, path, checkpoint, condition, availableNow=True).awaitTermination()

    write(folder / "app.log.1", "keep 1\ndrop\nkeep 2\n")
    ingest()
    write(folder / "app.log.2", "keep 3\nERROR keep 4\n")
    ingest()
    ingest()
    got = [tuple(r) for r in read_log_table(spark, path).orderBy("seq").select("seq", "level", "payload").collect()]
    assert got == [(1, "unknown", "keep 1"), (2, "unknown", "keep 2"), (3, "unknown", "keep 3"), (4, "error", "ERROR keep 4")]


def test_lines_of_a_file_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "log")
    file = write(tmp_path / "big.log", "".join(f"line {i}\n" for i in range(20_000)))
    append_batch(read_lines(spark, file, positions=True).repartition(5), path)
    assert [r[0] for r in read_log_table(spark, path).orderBy("seq").select("payload").collect()] == [
        f"line {i}" for i in range(20_000)
    ]
    assert set(POSITION) <= set(read_lines(spark, file, positions=True).columns)


def test_compaction_keeps_the_newest(spark, tmp_path):
    path, target = str(tmp_path / "log"), str(tmp_path / "compacted")
    for i in range(3):
        lines = spark.createDataFrame([(f"{i}-{j}",) for j in range(10)], "t string")
        append_batch(from_lines(lines, "t", "s", positions=True), path, "x", i)
    compact(spark, path, target, keep=12)
    assert sorted(r["seq"] for r in read_log_table(spark, target).collect()) == list(range(19, 31))
    assert append_batch(from_lines(spark.createDataFrame([("z",)], "t string"), "t", "s", positions=True), target, "x", 0) == 31


def _numbers(df):
    return sorted(r["seq"] for r in df.collect())


def _ten_batches(spark, path):
    for i in range(10):
        lines = spark.createDataFrame([(f"{i}-{j}",) for j in range(3)], "t string").coalesce(1)
        append_batch(from_lines(lines, "t", "s", positions=True), path, "x", i)


def test_versions_of_a_table_stay_readable_until_they_are_vacuumed(spark, tmp_path):
    path = str(tmp_path / "log")
    _ten_batches(spark, path)
    old = read_log_table(spark, path)
    assert evict(spark, path, 12) == 18 and _numbers(read_log_table(spark, path)) == list(range(19, 31))
    compact_in_place(spark, path)
    assert _numbers(read_log_table(spark, path)) == list(range(19, 31)) and len(list((tmp_path / "log" / "_merged").iterdir())) == 1
    assert _numbers(old) == list(range(1, 31))  # a reader that began before
    assert _numbers(read_log_table(spark, path, version=10)) == list(range(1, 31))
    assert vacuum(spark, path, 3600) == []
    again = from_lines(spark.createDataFrame([("z",)], "t string"), "t", "s", positions=True)
    assert append_batch(again, path, "x", 4) == 30  # a replay of a batch that is gone
    assert len(vacuum(spark, path, 0)) == 10 and _numbers(read_log_table(spark, path)) == list(range(19, 31))
    assert append_batch(again, path, "x", 10) == 31 and _numbers(read_log_table(spark, path)) == list(range(19, 32))
    assert evict(spark, path, 1) == 30 and _numbers(read_log_table(spark, path)) == [31]


def test_compaction_gives_way_and_keeps_what_came_meanwhile(spark, tmp_path, monkeypatch):
    from logevidence.sources import log_table

    path = str(tmp_path / "log")
    _ten_batches(spark, path)
    write, rivals = log_table._write_ordered, []

    def meanwhile(*args):
        write(*args)
        if not rivals:
            rivals.append(1)
            append_batch(from_lines(spark.createDataFrame([("late",)], "t string"), "t", "s", positions=True), path, "x", 10)
            compact_in_place(spark, path)  # the rival is faster

    monkeypatch.setattr(log_table, "_write_ordered", meanwhile)
    compact_in_place(spark, path)
    assert _numbers(read_log_table(spark, path)) == list(range(1, 32))
    assert len(list((tmp_path / "log" / "_merged").iterdir())) == 1  # the slower one's folder is gone


def test_staged_payload_is_removed_after_each_batch(spark, tmp_path):
    before = staging_root(spark)
    spark.conf.set("logevidence.staging.dir", str(tmp_path / "shared"))
    try:
        _ten_batches(spark, str(tmp_path / "log"))
    finally:
        spark.conf.set("logevidence.staging.dir", before)
    assert list((tmp_path / "shared").rglob("*.parquet")) == []
    assert len(list((tmp_path / "log").glob("stream=*/*/part-*.parquet"))) == 10


def test_a_table_without_versions_is_adopted(spark, tmp_path):
    path = str(tmp_path / "log")
    _ten_batches(spark, path)
    import shutil

    shutil.rmtree(tmp_path / "log" / "_versions")
    assert _numbers(read_log_table(spark, path)) == list(range(1, 31))
    assert append_batch(from_lines(spark.createDataFrame([("z",)], "t string"), "t", "s", positions=True), path, "y", 0) == 31
    assert _numbers(read_log_table(spark, path)) == list(range(1, 32))


# counters beside the table


def _several_sources(spark, path, batches=6):
    """Batches of three sources; one of them has rows in the first batch alone, one has no name."""
    for i in range(batches):
        rows = [("a", f"ERROR {i}"), (None, f"WARN {i}"), ("a", f"line {i}" + "x" * 300)] + [("dead", "last words")] * (i == 0)
        df = spark.createDataFrame([(j, *r) for j, r in enumerate(rows)], "n int, source string, payload string")
        df = df.withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000 + i * 60) + F.col("n")))
        append_batch(df.select("n", "timestamp", "source", detect_level(F.col("payload")).alias("level"), "payload"), path, "x", i, order_by=("n",))


def _rows_read(df):
    return [f for f in df.inputFiles() if "/log/" in f and "/_summaries/" not in f]


def test_counters_of_a_table_equal_those_of_its_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    assert table_source_stats(spark, path).count() == 0 and table_status(spark, path).first()["buffered"] == 0
    _several_sources(spark, path)

    def same(expect_rows=False):
        rows = read_log_table(spark, path)
        assert bool(_rows_read(read_counters(spark, path))) == expect_rows
        for kept, whole in (
            (table_source_stats(spark, path), source_stats(rows)), (table_source_totals(spark, path), source_totals(rows)),
            (table_horizon(spark, path), horizon(rows)), (table_status(spark, path), status(rows)),
        ):
            assert kept.columns == whole.columns and kept.collect() == whole.collect()

    same()
    compact_in_place(spark, path)
    same()
    assert len(read_counters(spark, path).inputFiles()) == 1
    append_batch(read_log_table(spark, path).limit(4).drop("seq").withColumn("n", F.monotonically_increasing_id()), path, "y", 0, order_by=("n",))
    same()
    evict(spark, path, 7)  # cuts through the merged folder, whose rows are counted anew
    same(expect_rows=True)
    evict(spark, path, 4)
    same()
    vacuum(spark, path, 0)
    same()
    assert len(list((tmp_path / "log" / "_summaries").rglob("part-*.parquet"))) == 1


def test_counters_of_an_older_version_and_of_folders_without_a_summary(spark, tmp_path):
    path = str(tmp_path / "log")
    _several_sources(spark, path, 3)
    files = TableFiles(spark, path)
    publish(files, lambda v: replace(v, folders=tuple(replace(f, summary=False) for f in v.folders[:1]) + v.folders[1:]))
    want = {("a", 6, 3, 0), (None, 3, 0, 3), ("dead", 1, 0, 0)}
    got = read_counters(spark, path)
    assert {(r["name"], r["total"], r["errors"], r["warns"]) for r in got.collect()} == want
    assert {f.rsplit("/", 2)[1] for f in _rows_read(got)} == {"batch=0"}
    assert read_counters(spark, path, version=1).agg(F.sum("total")).first()[0] == 4


def test_reading_after_a_cursor_skips_older_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    _ten_batches(spark, path)
    newer = read_log_table(spark, path, after=25)
    assert _numbers(newer) == [26, 27, 28, 29, 30] and {f.split("batch=")[1].split("/")[0] for f in newer.inputFiles()} == {"8", "9"}
    assert _numbers(read_log_table(spark, path, after=30)) == [] and _numbers(read_log_table(spark, path, after=0)) == list(range(1, 31))


def _indexed(spark, path, words):
    """Files of 50 lines each, one of which holds a word of its own."""
    lines = [(50 * i + j, datetime(2024, 1, 15) + timedelta(seconds=50 * i + j), "api", "info", word if j == 20 else f"plain line {j}")
             for i, word in enumerate(words) for j in range(50)]
    batch = spark.createDataFrame(lines, "n int, timestamp timestamp, source string, level string, payload string")
    for i in range(len(words)):
        append_batch(batch.where(f"n div 50 = {i}").coalesce(1), path, "b", i, order_by=("n",))


def _opened(df):
    return len({f.rpartition("/")[2] for f in df.inputFiles()})


def test_a_search_opens_only_files_that_may_match(spark, tmp_path):
    path = str(tmp_path / "log")
    words = ["disk quota spent", "tls handshake refused", "TİTLE of Key", "café closed", "a.b(c)", "Straße zu"]
    _indexed(spark, path, words)
    patterns = {
        "quota sp": 1, "(?i)HANDSHAKE": 1, "(?iu)title": 1, "(?i)of key": 1, "café clo": 1, r"a\.b\(c\)": 1, "(?i)stra": 1,
        "nowhere": 0, "quota|refused": 2, "quota|x": 6, "quotas? spent": 1, "quot(a|b) spent": 1, "plain line 7$": 6, r"\bspent\b": 1,
        "[q]uota.*spent": 1, "": 6, "(?x) q u o t a": 6, r"\x71uota": 6, "refusedd*": 1, "han{1,2}dshake": 1, "line (?:[0-9)]+) ?": 6,
    }
    assert index_grams(spark, path) == [f"stream=b/batch={i}" for i in range(len(words))] and index_grams(spark, path) == []
    for pattern, files in patterns.items():
        found = read_log_table(spark, path, grep=pattern)
        assert _opened(found) == files, pattern
        plain = read_log_table(spark, path).where(payload_matches(check_pattern(pattern)))
        assert _numbers(found) == _numbers(plain), pattern
    with pytest.raises(ValueError, match="invalid `grep`"):
        read_log_table(spark, path, grep="(")


def test_indexes_go_with_their_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    _indexed(spark, path, ["first word", "second word", "third word"])
    index_grams(spark, path)
    compact_in_place(spark, path)
    assert read_log_table(spark, path, grep="second").count() == 1  # the merged folder is not indexed yet
    (merged,) = index_grams(spark, path)
    assert merged.startswith("_merged/") and read_log_table(spark, path, grep="no such").inputFiles() == []
    vacuum(spark, path, 0)
    assert not list((tmp_path / "log" / "_grams").glob("stream=*/batch=*")) and (tmp_path / "log" / "_grams" / merged).exists()
    evict(spark, path, 60)
    assert read_log_table(spark, path, grep="first").count() == 0 and read_log_table(spark, path, grep="third").count() == 1
    assert read_log_table(spark, path, grep="line", after=145).count() == 5
    assert read_log_table(spark, str(tmp_path / "none"), grep="x").count() == 0
    answer = search_table(spark, path, grep="(?i)WORD", limit=1)
    assert [r.payload for r in answer.rows.collect()] == ["third word"]
    same = search_logs(read_log_table(spark, path), grep="(?i)WORD", limit=1).envelope
    assert answer.envelope.collect() == same.collect()


def test_a_search_that_many_files_may_match_lists_folders_and_leaves_the_other_files_unopened(spark, tmp_path):
    path = tmp_path / "log"
    lines = spark.range(1, 251).selectExpr(
        "id AS n", "timestamp'2024-01-15' AS timestamp", "'api' AS source", "'info' AS level",
        "CASE WHEN id BETWEEN 101 AND 110 THEN 'other' WHEN id = 7 THEN NULL ELSE 'wanted row' END AS payload",
    )
    append_batch(lines.where("n <= 240"), str(path), "b", 0, order_by=("n",))
    append_batch(lines.where("n > 240"), str(path), "b", 1, order_by=("n",))
    compact_in_place(spark, str(path), rows_per_file=2)
    index_grams(spark, str(path))
    index = spark.read.parquet(str(path / "_grams" / "_merged" / "*" / "places"))
    assert index.count() < 125 * 20  # as many rows as runs, and one for the name; no bitmap for each file
    held = spark.read.parquet(str(path / "_merged" / "*")).groupBy(F.col("_metadata.file_name").alias("file"))
    others = [r.file for r in held.agg(F.bool_and(F.col("payload") == "other").alias("other")).where("other").collect()]
    assert len(others) >= 4
    for name in others:
        (file,) = (path / "_merged").glob(f"*/{name}")
        (file.parent / f".{name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"not to be opened")
    spark.sparkContext.setJobGroup("many files", "")
    try:
        found = read_log_table(spark, str(path), grep="wanted")
        assert found.count() == 239
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many files") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 100  # not a task for each file
