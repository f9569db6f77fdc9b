"""Log tables derived from the given test tables.

``LOG_COLUMNS`` runs unchanged in Spark SQL and in DuckDB. It turns every event into a log
line: repeated failures with changing ports and ids, JSON with levels as names and numbers, stack
frames, blank lines, and source names that contain one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logevidence.functions import detect_level
from logevidence.session import prepare

LOG_COLUMNS = {
    "seq": "event_id + 1",
    "timestamp": "ts",
    "source": """
 CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'api' WHEN 1 THEN 'web' WHEN 2 THEN 'worker' WHEN 3 THEN 'db' ELSE 'api-gateway' END""",
    "payload": """
 CASE
  WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'ERROR quota spent: bucket:' || CAST(7731 + event_id % 7 AS VARCHAR(20))
  WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'request ' || substring(md5(CAST(event_id AS VARCHAR(20))),1,8) || '-' || substring(md5(CAST(event_id AS VARCHAR(20))),9,4) || '-4' || substring(md5(CAST(event_id AS VARCHAR(20))),14,3) || '-a' || substring(md5(CAST(event_id AS VARCHAR(20))),18,3) || '-' || substring(md5(CAST(event_id AS VARCHAR(20))),21,12) || ' failed'
  WHEN event_type = 'error' AND event_id % 4 = 2 THEN '{"level":"error","msg":"timeout","user":' || CAST(user_id AS VARCHAR(20)) || '}'
  WHEN event_type = 'error' THEN 'TypeError: cannot read "field' || CAST(user_id AS VARCHAR(20)) || '" of undefined'
  WHEN event_type = 'view' AND event_id % 4 < 3 THEN '    at Handler.run (app.js:' || CAST(event_id % 97 AS VARCHAR(20)) || ':' || CAST(user_id AS VARCHAR(20)) || ')'
  WHEN event_type = 'view' THEN 'Check ended with 0 errors'
  WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'WARN slow query took ' || CAST(user_id AS VARCHAR(20)) || 'ms'
  WHEN event_type = 'click' THEN '{"severity":' || CAST(event_id % 9 AS VARCHAR(20)) || ',"message":"error share low"}'
  WHEN event_type = 'purchase' THEN 'INFO order 0x' || substring(md5(CAST(event_id AS VARCHAR(20))),1,8) || ' accepted'
  WHEN event_id % 3 = 0 THEN props
  WHEN event_id % 3 = 1 THEN '[debug] cache miss at 10.0.0.' || CAST(user_id AS VARCHAR(20)) || ':6379'
  ELSE '   '
 END""",
}

# Instants and ages in all forms, also such as name none; the SQL of the check tells their meaning from seq and timestamp.
SINCE_TEXT = """
 CASE CAST(seq % 8 AS INT)
  WHEN 0 THEN substring(CAST(timestamp AS VARCHAR(30)), 1, 10) || 'T' || substring(CAST(timestamp AS VARCHAR(30)), 12, 8) || '.0' || CAST(seq % 10 AS VARCHAR(20)) || '5+02:30'
  WHEN 1 THEN substring(CAST(timestamp AS VARCHAR(30)), 1, 10) || ' ' || substring(CAST(timestamp AS VARCHAR(30)), 12, 8) || '.0000001z'
  WHEN 2 THEN ' ' || CAST(seq AS VARCHAR(20)) || 'm'
  WHEN 3 THEN '+' || CAST(seq % 50 AS VARCHAR(20)) || 'd '
  WHEN 4 THEN CAST(seq AS VARCHAR(20)) || 'h'
  WHEN 5 THEN '2024-13-01T00:00:00Z'
  WHEN 6 THEN CAST(seq AS VARCHAR(20)) || 'w'
  ELSE '9999999d'
 END"""

# Lifecycle events: some sources register, two of the log's sources never do, one registers and stays quiet.
LIFECYCLE_COLUMNS = {
    "name": "CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'api' WHEN 1 THEN 'web' WHEN 3 THEN 'db' ELSE 'quiet-api' END",
    "status": "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'starting' WHEN 1 THEN 'running' WHEN 2 THEN 'exited' ELSE 'failed' END",
    "detail": "CASE WHEN event_id % 4 = 3 THEN 'exit code ' || CAST(event_id % 7 AS VARCHAR(20)) END",
    "changed_at": "ts",
}
LIFECYCLE_WHERE = "event_type = 'signup' AND user_id % 5 <> 4"


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


def _columns(columns: dict[str, str]) -> list:
    return [F.expr(expression).alias(name) for name, expression in columns.items()]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def raw_logs(events: DataFrame) -> DataFrame:
    """Log rows of (batch or streaming) events, without level."""
    return events.select(*_columns(LOG_COLUMNS))


def with_level(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "timestamp", "source", detect_level(F.col("payload")).alias("level"), "payload")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """The derived log with its level inferred."""
    return with_level(raw_logs(table(spark, sf, "events")))


def log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The derived log as a stream of the events file."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return with_level(raw_logs(events))


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(LIFECYCLE_WHERE).select(*_columns(LIFECYCLE_COLUMNS))


def text_lines(spark: SparkSession, sf: str, name: str, key: str, text: str, *extra: str) -> DataFrame:
    """Every line of every text of a table: ``key, line, payload`` and more columns of the text."""
    return table(spark, sf, name).select(key, *extra, F.posexplode(F.split(text, "\n")).alias("line", "payload"))
