from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logevidence.functions import detect_level  # noqa: E402
from logevidence.session import build_session  # noqa: E402

START = datetime(2024, 1, 15, 10, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_logs(spark):
    """Log rows from (source, level, payload) triples; level None means inferred."""

    def make(rows, start: int = 1, step_ms: int = 1000):
        data = [
            (start + i, START + timedelta(milliseconds=step_ms * i), source, level, payload)
            for i, (source, level, payload) in enumerate(rows)
        ]
        from pyspark.sql import functions as F

        df = spark.createDataFrame(data, "seq bigint, timestamp timestamp_ntz, source string, level string, payload string")
        if all(level for _, level, _ in rows):
            return df
        return df.withColumn("level", F.coalesce("level", detect_level(F.col("payload"))))

    return make


@pytest.fixture(scope="session")
def apply(spark):
    """Values of a column function over a list of texts, in order."""

    def run(function, texts):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
        return [r[0] for r in df.select(function(F.col("t")).alias("v"), "i").orderBy("i").collect()]

    return run


FLOOD = (
    [("web", "info", "bundle ready")]
    + [("api", "error", "ERROR quota spent: bucket:7731")] * 30
    + [("api", "unknown", "    at Writer.flush (store.js:17)")]
)
