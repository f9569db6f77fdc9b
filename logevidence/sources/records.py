"""Records as JSON lines: the wire form other programs read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.queries import json_records
from ..schema import LOG_SCHEMA

RECORD_SCHEMA = T.StructType([*LOG_SCHEMA.fields, T.StructField("payload_truncated_from", T.LongType())])


def write_records(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; fields without a value are left out. Runs one job."""
    json_records(rows).write.mode(mode).text(path)


def read_records(spark: SparkSession, path: str, stream: bool = False, malformed: str = "fail") -> DataFrame:
    """Records from JSON lines; nothing is inferred.

    ``malformed`` says what becomes of lines that are no such record: ``fail`` stops the read,
    ``keep`` returns them as rows with their text in one more column, ``rejected`` (null for
    records), so that they can be counted and stored, and ``skip`` leaves them out.
    """
    if malformed not in ("fail", "keep", "skip"):
        raise ValueError(f"invalid `malformed`: {malformed!r} (expected fail, keep or skip)")
    reader = spark.readStream if stream else spark.read
    if malformed == "fail":
        return reader.schema(RECORD_SCHEMA).option("mode", "FAILFAST").json(path)
    schema = T.StructType([*RECORD_SCHEMA.fields, T.StructField("rejected", T.StringType())])
    rows = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "rejected").json(path)
    return rows if malformed == "keep" else rows.where(F.col("rejected").isNull()).drop("rejected")
