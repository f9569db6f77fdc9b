from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from logevidence.operators import retain_newest
from logevidence.plans import (
    QueryArgs, log_sources, log_status, recent_errors, records, render_groups, render_records, render_sources,
    render_wait, search_logs, to_json_lines,
)
from logevidence.plans.queries import Result
from logevidence.schema import LIFECYCLE_SCHEMA
from tests.conftest import FLOOD


def envelope(answer):
    return answer.envelope.first().asDict()


def text(df):
    return "\n".join(r["line"] for r in df.orderBy("row").collect())


@pytest.fixture(scope="module")
def flood(make_logs):
    return make_logs(FLOOD)


# errors


def test_errors_fold_and_default_to_error_level(flood):
    answer = recent_errors(flood)
    rows = answer.rows.collect()
    assert len(rows) == 1 and rows[0]["count"] == 30 and rows[0]["level"] == "error"
    assert rows[0]["sample"] == "ERROR quota spent: bucket:7731"
    assert rows[0]["context"] == ["    at Writer.flush (store.js:17)"]
    env = envelope(answer)
    assert (env["distinct"], env["total_matching"], env["truncated"], env["next_cursor"]) == (1, 30, False, 32)


def test_errors_context_can_be_left_out_and_level_widened(flood):
    assert recent_errors(flood, context_lines=0).rows.first()["context"] == []
    assert envelope(recent_errors(flood, level="info"))["distinct"] == 2


def test_two_failures_most_recent_first(make_logs):
    rows = [("api", "error", f"ERROR quota spent: bucket:{7731 + i % 2}") for i in range(200)]
    rows += [("web", "error", "ERROR lease lost")] * 50
    got = recent_errors(make_logs(rows), context_lines=0).rows.collect()
    assert [(g["count"], g["sources"]) for g in got] == [(50, ["web"]), (200, ["api"])]


def test_sources_of_a_group_most_frequent_first(make_logs):
    logs = make_logs([("api", "error", "ERROR lease lost")] + [("worker", "error", "ERROR lease lost")] * 2)
    assert recent_errors(logs).rows.first()["sources"] == ["worker", "api"]


def test_sample_follows_seq_and_times_follow_timestamps(make_logs):
    logs = make_logs([("a", "error", "ERROR 1"), ("a", "error", "ERROR 2"), ("a", "warn", "ERROR 3")])
    late = logs.withColumn("timestamp", F.when(F.col("seq") == 1, F.expr("timestamp + INTERVAL 1 DAY")).otherwise(F.col("timestamp")))
    row = recent_errors(late, level="warn").rows.first()
    assert row["sample"] == "ERROR 3" and row["last_seen"].day == 16 and row["level"] == "error"


def test_group_limit_is_announced(make_logs):
    logs = make_logs([("api", "error", f"ERROR distinct kind {chr(97 + i % 26)}") for i in range(50)])
    answer = recent_errors(logs, limit=5)
    assert answer.rows.count() == 5
    env = envelope(answer)
    assert (env["distinct"], env["truncated"]) == (26, True)
    assert recent_errors(logs).rows.count() == 20


def test_no_errors(flood):
    answer = recent_errors(flood, grep="never")
    assert answer.rows.count() == 0
    assert envelope(answer)["total_matching"] == 0


# search


def test_search_keeps_the_newest_and_says_so(flood):
    answer = search_logs(flood, level="error", limit=5)
    assert [r["seq"] for r in answer.rows.collect()] == [27, 28, 29, 30, 31]
    env = envelope(answer)
    assert (env["total_matching"], env["truncated"], env["cursor_gap"]) == (30, True, False)


def test_search_after_cursor(flood, make_logs):
    cursor = envelope(search_logs(flood))["next_cursor"]
    grown = flood.unionByName(make_logs([("api", "error", "ERROR valve 9 stuck")], start=cursor + 1))
    assert [r["payload"] for r in search_logs(grown, cursor=cursor).rows.collect()] == ["ERROR valve 9 stuck"]


def test_search_reports_a_gap(make_logs):
    kept = retain_newest(make_logs([("api", "info", str(i)) for i in range(4)]), 2)
    env = envelope(search_logs(kept, cursor=1))
    assert (env["cursor_gap"], env["buffer_start_cursor"]) == (True, 3)


def test_payloads_are_elided_only_in_answers(make_logs):
    logs = make_logs([("api", "info", "x" * 12_000)])
    row = search_logs(logs, max_payload_chars=10_000).rows.first()
    assert row["payload"].endswith("… [+2000 chars]") and row["payload_truncated_from"] == 12_000
    assert len(search_logs(logs).rows.first()["payload"]) < 2_100
    assert len(records(logs).first()["payload"]) == 12_000


def test_a_timestamp_column_works_too(flood):
    zoned = flood.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert search_logs(zoned, since="2024-01-15T10:00:30Z").rows.count() == 2
    assert recent_errors(zoned).rows.count() == 1


@pytest.mark.parametrize(
    "bad",
    [{"grep": "[[[bad"}, {"level": "loud"}, {"since": "yesterday"}, {"since": "🕒"}, {"limit": 0}, {"limit": "abc"},
     {"max_payload_chars": 0}, {"context_lines": 51}, {"cursor": -1}, {"source": 3},
     {"limit": 1001}, {"max_payload_chars": 10_001}],
)
def test_bad_arguments_never_look_like_an_empty_answer(spark, bad):
    with pytest.raises(ValueError, match=next(iter(bad))):
        QueryArgs(**bad)


def test_unknown_arguments_are_rejected(flood):
    with pytest.raises(TypeError):
        search_logs(flood, grpe="x")


def test_empty_text_counts_as_absent(spark):
    args = QueryArgs(grep="", source="", level="", since="", limit=1000)
    assert (args.grep, args.source, args.limit) == (None, None, 1000)
    assert QueryArgs(context_lines=50).context_lines == 50


def test_records_ignore_a_bad_pattern(flood):
    assert records(flood, grep="[[[bad", source="web").count() == 1


def test_sources_and_status(spark, flood):
    lifecycle = spark.createDataFrame([], LIFECYCLE_SCHEMA)
    answer = log_sources(flood, lifecycle)
    rows = answer.rows.collect()
    assert [(r["name"], r["errors"]) for r in rows] == [("api", 30), ("web", 0)]
    assert tuple(answer.envelope.first()) == (32, 32)
    row = log_status(flood).first()
    assert row["ok"] and row["buffered"] == 32 and row["version"]


# rendering


def test_rendered_records(flood):
    out = text(render_records(search_logs(flood, limit=2)))
    assert out.startswith("2 of 32 matches") and "next cursor 32" in out
    assert "10:00:30 error api ERROR quota spent" in out
    whole = text(render_records(search_logs(flood, source="web")))
    assert whole.startswith("1 match | next cursor 32") and "info  web bundle" in whole
    assert text(render_records(search_logs(flood, grep="never"))) == "0 matches\nnext cursor 32"
    assert "! rows after your cursor are gone" in text(render_records(search_logs(flood, cursor=99)))


def test_rendered_groups(flood, make_logs):
    out = text(render_groups(recent_errors(flood)))
    assert "1 kind of failure in 30 rows" in out and "log begins at 10:00:00" in out
    assert "[1] x30 error api first 10:00:01 last 10:00:30" in out and "\n      at Writer.flush (store.js:17)" in out
    quiet = text(render_groups(recent_errors(flood, grep="never")))
    assert quiet.startswith("0 failures; log begins at 10:00:00.")
    empty = text(render_groups(recent_errors(flood.where("false"))))
    assert "log holds nothing" in empty
    many = make_logs([("api", "error", f"ERROR kind {c}") for c in "pqrstu"])
    assert "the 2 seen last are listed; `limit` leaves out 4" in text(render_groups(recent_errors(many, limit=2)))


def test_rendered_sources(spark, flood):
    lifecycle = spark.createDataFrame([], LIFECYCLE_SCHEMA)
    out = text(render_sources(log_sources(flood, lifecycle)))
    assert out.startswith("2 sources | 32 rows in the log") and "   30 err" in out and "bundle ready" in out
    silent = text(render_sources(log_sources(flood.where("false"), lifecycle)))
    assert silent.startswith("0 sources")


def test_rendered_wait_never_sells_an_old_line_as_new(flood):
    rows = search_logs(flood, source="web").rows

    def wait(**fields):
        base = {"matched": True, "matched_from_buffer": False, "waited_ms": 1840, "next_cursor": 32} | fields
        return text(render_wait(Result(rows, flood.sparkSession.createDataFrame([base]))))

    assert wait().startswith("new match; waited 1840 ms")
    stale = wait(matched_from_buffer=True)
    assert "from before the wait, written at 10:00:00" in stale and "since" in stale and "new match" not in stale
    assert "no match" in wait(matched=False)


def test_json_form(flood):
    first = json.loads(to_json_lines(search_logs(flood, source="web").rows).first()["value"])
    assert first == {"seq": 1, "timestamp": "2024-01-15T10:00:00Z", "source": "web", "level": "info",
                     "payload": "bundle ready"}
    group = json.loads(to_json_lines(recent_errors(flood).rows).first()["value"])
    assert group["first_seen"] == "2024-01-15T10:00:01Z" and group["context"] == ["    at Writer.flush (store.js:17)"]
    assert "context" not in json.loads(to_json_lines(recent_errors(flood, context_lines=0).rows).first()["value"])
    assert json.loads(to_json_lines(search_logs(flood).envelope).first()["value"])["total_matching"] == 32
