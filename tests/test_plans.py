"""The physical plans: what is pushed down, what is shuffled, what is shared."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from logevidence.operators import (
    burst_from, error_groups, filter_logs, horizon, retain_newest, source_stats, tail_per_source, trailing_context,
)
from logevidence.operators.stats import source_counters
from logevidence.plans import recent_errors, search_logs
from logevidence.sources import append_batch, read_log_table
from registered.tables import logs as derived_logs


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "log")
    append_batch(derived_logs(spark, "/root/testdata/sf0.001"), path, order_by=("timestamp",))
    return read_log_table(spark, path)


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def shuffles(text: str) -> int:
    return len(re.findall(r"\bExchange (?:hash|range)partitioning", text))


def scans(df) -> list[str]:
    """Pushed filters and read schema of every scan."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    text = out.getvalue()
    blocks = [b for b in text.split("\n\n") if re.match(r"\n*\(\d+\) Scan parquet", b)]
    field = lambda block, name: (re.search(rf"^{name}: (.*)$", block, re.M) or ["", ""])[1]
    return [(field(b, "PushedFilters"), field(b, "ReadSchema").removeprefix("struct<").removesuffix(">")) for b in blocks]


def test_filters_and_columns_reach_the_scan(logs):
    df = filter_logs(logs, cursor=10, since="2024-01-01T01:00:00Z", level="warn").select("seq")
    ((pushed, columns),) = scans(df)
    assert "GreaterThan(seq,10)" in pushed and "GreaterThanOrEqual(timestamp," in pushed and re.search(r"In\(level, \[(warn,error|error,warn)\]\)", pushed)
    assert "payload" not in columns and "source" not in columns
    assert scans(horizon(logs))[0][1] == "seq:bigint,timestamp:timestamp"


def test_top_k_reads_only_the_chunks_that_can_hold_it(logs):
    rows = search_logs(logs, level="warn").rows
    text = plan(rows)
    assert "TakeOrderedAndProject" in text and "Window [row_number" not in text
    assert any("GreaterThanOrEqual(seq,ScalarSubquery" in pushed for pushed, _ in scans(rows))


def test_retention_is_a_filter(logs):
    for df in (retain_newest(logs, 100), retain_newest(logs, 100, dense=True)):
        main = plan(df).split("Subquery")[0]
        assert "Exchange" not in main and "Sort" not in main
    assert "GreaterThan(seq,ScalarSubquery" in scans(retain_newest(logs, 100, dense=True))[0][0]


def test_groups_are_hash_aggregated_with_map_side_combine(logs):
    text = plan(error_groups(filter_logs(logs, level="error")))
    assert "SortAggregate" not in text and "partial_count(1)" in text
    assert shuffles(text) == 2  # (fingerprint, source), then fingerprint
    counters = source_counters(logs)
    assert "SortAggregate" not in plan(counters) and "payload" not in scans(counters)[0][1]


def test_context_shuffles_the_log_once(logs):
    text = plan(trailing_context(logs, 8, F.col("level") == "error"))
    assert len(re.findall(r"FileScan parquet", text)) == 1 and "ReusedExchange" in text


def test_context_of_shown_groups_does_not_shuffle_the_log(logs):
    text = plan(recent_errors(logs).rows)
    assert "WindowGroupLimit" in text and "Partial" in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("query", [
    lambda logs: recent_errors(logs).rows, lambda logs: recent_errors(logs).envelope,
    lambda logs: search_logs(logs, cursor=5).envelope, source_stats, tail_per_source,
    lambda logs: burst_from(logs, 10, 5),
])
def test_no_cross_joins(logs, query):
    text = plan(query(logs))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_everything_stays_in_the_jvm(logs):
    for df in (recent_errors(logs).rows, search_logs(logs, grep="x").rows, source_stats(logs)):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_heads_of_a_hot_source_are_combined_in_ranges(spark):
    """One source with nine tenths of the rows, many chunks: no task of the carry sees more heads than a range has."""
    from logevidence.operators.context import _carries

    item = "struct<kind:int,line:string>"
    hot = spark.range(3000).select(F.lit("hot").alias("source"), F.col("id").alias("chunk"))
    cold = spark.range(300).select(F.concat(F.lit("cold"), F.col("id") % 30).alias("source"), (F.col("id") * 10).alias("chunk"))
    line = F.struct(F.when(F.col("chunk") % 5 == 4, 1).otherwise(0).alias("kind"), F.concat("source", F.lit("-"), "chunk").alias("line"))
    heads = hot.unionByName(cold).withColumn("head", F.array(line).cast(f"array<{item}>"))
    got = {(r["source"], r["chunk"]): [x["line"] for x in r["carry"]] for r in _carries(heads, 8, 64).collect()}
    plain: dict = {}
    for r in heads.collect():
        plain.setdefault(r["source"], []).append((r["chunk"], r["head"][0]))
    for source, chunks in plain.items():
        chunks.sort()
        for i, (chunk, _) in enumerate(chunks):
            want = []
            for _, x in chunks[i + 1 : i + 9]:
                want.append(x["line"])
                if x["kind"]:
                    break
            assert got[source, chunk] == want
    per_key = heads.groupBy("source", F.floor(F.col("chunk") / 64).alias("range")).count().agg(F.max("count")).first()[0]
    assert per_key == 64


def test_context_of_shown_groups_joins_on_source_and_bucket(logs):
    from logevidence.operators.context import context_of

    text = plan(context_of(logs, logs.where(F.col("level") == "error").orderBy(F.desc("seq")).limit(20).select("seq", "source"), 8))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
