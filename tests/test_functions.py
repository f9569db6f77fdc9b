from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logevidence import functions as fn
from logevidence.functions.levels import level_of_rank, parse_level
from tests import model

LEVELS = {
    "ERROR: quota spent": "error",
    "error: no lease": "error",
    "FATAL: heap is full": "error",
    "one err in the batch": "error",
    "Failed to open the store": "error",
    "worker 3 panicked in flush.rs": "error",
    "IndexOutOfBoundsException": "error",
    "StoreError: y": "error",
    "storeerror: y": "unknown",
    "_error_": "unknown",
    "Segmentation Fault in plugin": "error",
    "Unhandled Rejection in loader": "error",
    "Traceback (most recent call last):": "error",
    "WARN: queue is long": "warn",
    "warning: old flag": "warn",
    "forewarned": "unknown",
    "INFO: store is open": "info",
    "[info] bound to :7731": "info",
    "information": "unknown",
    "DEBUG: page read": "debug",
    "[debug] merging": "debug",
    "TRACE: leaving merge": "trace",
    "debug trace info": "debug",
    "trace info": "trace",
    "store listens on 7731": "unknown",
    "bundle ready": "unknown",
    "Check ended with 0 errors": "unknown",
    "Check ended with 10 errors": "unknown",
    "Check ended with 12 errors": "error",
    "0 errors, some warnings": "warn",
    "no failures so far": "unknown",
    "error-free run": "unknown",
    "terror is no word for it": "unknown",
    "Error: odd page": "error",
    "error/warn both": "error",
    '{"level":"warn","message":"error share low"}': "warn",
    '{"severity_text":"ERROR","message":"odd"}': "error",
    '{"log":{"level":"debug"},"message":"x"}': "debug",
    '{"log.level":"error","message":"odd"}': "error",
    '{"severity":3,"message":"x"}': "error",
    '{"severity":4}': "warn",
    '{"severity":6}': "info",
    '{"severity":7}': "debug",
    '{"severity":8}': "unknown",
    '{"severity":-1}': "unknown",
    '{"severity":3.0}': "unknown",
    '{"severity":"3"}': "unknown",
    '{"severity":8,"log_level":"info"}': "info",
    '{"level":"  WARNING "}': "warn",
    '{"level":"CRITICAL"}': "error",
    '{"level":"any","msg":"error"}': "unknown",
    '{"Level":"warn","level":"info"}': "warn",
    '{"LEVEL":"loud","level":"dbg"}': "unknown",
    '{"level":true,"severity":"info"}': "info",
    '{"level":"info"} error': "error",
    '["level","error"]': "error",
    '  {"level":"trace"}\t': "trace",
    "": "unknown",
}


def test_detect_level(apply):
    assert dict(zip(LEVELS, apply(fn.detect_level, list(LEVELS)))) == LEVELS


def test_parse_level(apply):
    names = [" Trace", "TRC", "debug", "dbg", "info", "inf", "warn", "Warning", "wrn", "error", "err", "fatal ", "unknown",
             "any", "all", "loud", "", None]
    want = ["trace"] * 2 + ["debug"] * 2 + ["info"] * 2 + ["warn"] * 3 + ["error"] * 3 + ["unknown"] * 3 + [None] * 3
    assert apply(parse_level, names) == want


def test_severity_orders_levels_and_back(apply):
    names = ["unknown", "trace", "debug", "info", "warn", "error", "loud", None]
    assert apply(fn.severity, names) == [0, 1, 2, 3, 4, 5, None, None]
    assert apply(lambda c: level_of_rank(fn.severity(c)), names[:6]) == names[:6]
    assert apply(fn.level_label, ["warn", "unknown"]) == ["WARN ", "UNKNO"]


FINGERPRINTS = {
    "quota spent: bucket:7731": "quota spent: bucket:<N>",
    "request 0b7f3c52-91de-4c08-9a77-2d1e6f8b4c30 failed": "request <UUID> failed",
    "id abcdabcd-abcd-abcd-abcd-abcdabcdabcd:": "id <UUID>",
    "abcdefab0b7f3c52-91de-4c08-9a77-2d1e6f8b4c30": "abcdefab<UUID>",
    'No page named "left"': "No page named <S>",
    "it's `x` and 'y'": "it<S>y'",
    "  at Page.read   (y)": "at Page.read (y)",
    'error: a lone " here': 'error: a lone " here',
    "at 2024-01-15T10:00:00Z": "at <TIME>",
    "at 2024-01-15T10:00Z": "at <TS>",
    "host 10.0.0.1 v1.2.3 10.0.0.1:80": "host <ADDR> v<ADDR> <ADDR>",
    "0xdeadbeef deadbeef 0x12 12345678 beef": "<HEX> <HEX> <N> <HEX> beef",
    "a0x12345678 zdeadbeef1 deadbeefz": "a<HEX> z<HEX> deadbeefz",
    "x  y\x85z": "x y z",
}


def test_fingerprint_examples(apply):
    assert dict(zip(FINGERPRINTS, apply(fn.fingerprint, list(FINGERPRINTS)))) == FINGERPRINTS


def test_fingerprint_is_bounded_and_survives_long_runs(apply):
    texts = ["e" * 5000, "a" * 200_000 + "g", '"' * 100_001, ("ab-" * 50_000), "0x" * 60_000, "'" + "x" * 300 + "'"]
    for text, got in zip(texts, apply(fn.fingerprint, texts)):
        assert len(got) <= 300
        if len(text) < 10_000:  # the model is quadratic
            assert got == model.fingerprint(text)


def test_fingerprint_matches_the_model_on_random_lines(apply):
    rng = random.Random(7)
    parts = ["abc", "dead", "beef", "0x", "12", "345678", ":", ".", "-", "_", "+", " ", "\t", " ", '"', "'", "`", "T", "Z",
             "é", "\n", "(", "<UUID>", "0b7f3c52-91de-4c08-9a77-2d1e6f8b4c30", "cafebabe", "10.0.0.1", "x" * 190, "\U0001f525"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(4000)]
    wrong = [(t, g, model.fingerprint(t)) for t, g in zip(texts, apply(fn.fingerprint, texts)) if g != model.fingerprint(t)]
    assert not wrong[:3]


def test_is_json(apply):
    texts = ['{"level":"info","msg":"ok"}', "[1,2,3]", " [] ", "pump 4 primed", "{a brace}", '{"a":1} junk', '{"a":1}]',
             '{"a":1},{"b":2}', "[1]]", "[1", "3", '"x"', "", None]
    assert apply(fn.is_json, texts) == [True, True, True] + [False] * 11


def test_flatten_json(apply):
    cases = {
        '{"level":"info","status":200,"ok":true}': "level=info  ok=true  status=200",
        '{"note":"two  blanks, one = sign"}': "note=two  blanks, one = sign",
        '{"meta":{"host":"x"}}': 'meta={"host":"x"}',
        '{"b":null,"a":[1, "y"],"B":-2}': 'B=-2  a=[1,"y"]  b=null',
        '{"x":1.50,"y":2.0,"z":0.25}': "x=1.5  y=2.0  z=0.25",
        '{"a":1,"a":2}': "a=2",
        "[1,2,3]": "[1,2,3]",
        "{}": "",
        "not json": None,
        '"text"': None,
        '{"a":1} junk': None,
    }
    assert dict(zip(cases, apply(fn.flatten_json, list(cases)))) == cases


def test_elide_counts_characters(apply):
    texts = ["x" * 500, "é🔥" * 60, "short", ""]
    got = apply(lambda c: F.struct(*fn.elide(c, 100)), texts)
    assert got[0] == ("x" * 100 + "… [+400 chars]", 500)
    assert got[1] == ("é🔥" * 50 + "… [+20 chars]", 120)
    assert got[2:] == [("short", None), ("", None)]


def test_preview_and_line_endings(apply):
    assert apply(lambda c: fn.preview(c, 3), ["abcdef", "a\nb", "a\r\n"]) == ["abc…", "a b", "a  "]
    assert apply(lambda c: fn.strip_line_ending(c, "file"), ["a\r\n\r\n", "a\nb\n"]) == ["a", "a\nb"]
    assert apply(lambda c: fn.strip_line_ending(c, "container"), ["a\r\n\n", "a\r"]) == ["a\r", "a\r"]
    assert apply(lambda c: fn.strip_line_ending(c, "lines"), ["a\r\n\n", "a\r\n"]) == ["a\r\n", "a"]


def test_times(spark):
    instants = ("1999-12-31T23:59:59.000999Z", "2031-03-17T04:05:09Z", "2024-02-29T00:00:00.500Z")
    df = spark.createDataFrame([(t,) for t in (*instants, None)], "s string").select(F.to_timestamp("s").alias("t"))
    rows = df.select(fn.short_time(F.col("t")), fn.clock_ms(F.col("t")), fn.rfc3339(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["23:59:59", "04:05:09", "00:00:00", "?"]
    assert [r[1] for r in rows] == ["23:59:59.000", "04:05:09.000", "00:00:00.500", None]
    assert [r[2] for r in rows] == [*instants, None]


def test_parse_since():
    leap = datetime(2028, 2, 29, 0, 10, tzinfo=timezone.utc)
    ages = {"45s": timedelta(seconds=45), "11m": timedelta(minutes=11), "+3h": timedelta(hours=3), " 60d ": timedelta(days=60)}
    for text, age in ages.items():
        assert fn.parse_since(text, leap) == leap - age
    assert fn.parse_since("2027-11-30T23:30:00Z") == datetime(2027, 11, 30, 23, 30, tzinfo=timezone.utc)
    assert fn.parse_since("2027-12-31T23:30:00.125-01:00") == datetime(2028, 1, 1, 0, 30, 0, 125_000, tzinfo=timezone.utc)
    assert fn.parse_since("9999999d", leap).year == 1
    for bad in ("last week", "-2h", "", "ü", "7", "h", "2w", "2027-02-30T00:00:00Z", "2027-11-30"):
        with pytest.raises(ValueError, match="since"):
            fn.parse_since(bad)


def test_since_of_a_column_is_that_of_a_value(apply):
    texts = [
        "5m", " 1d ", "+3h", "90s", "9999999d", "7w", "", "m", "2025-02-28T23:59:60Z", "2025-02-29T00:00:00Z", "2024-02-29t10:00:00.1234567-11:30",
        "2024-02-29 10:00:00+00:00", "2024-02-29T10:00:00", "2024-02-29T10:00:00.Z", "0001-01-01T00:00:00Z", "2024-12-31T23:59:59.9999999Z",
    ]
    as_of = datetime(2026, 3, 2, 8, 30, tzinfo=timezone.utc)

    def plain(text):
        try:
            return fn.parse_since(text, as_of).replace(tzinfo=None)
        except ValueError:
            return None

    got = apply(lambda c: fn.since_instant(c, F.lit("2026-03-02 08:30:00Z").cast("timestamp")).cast("timestamp_ntz"), [*texts, None])
    assert got == [*map(plain, texts), None]
