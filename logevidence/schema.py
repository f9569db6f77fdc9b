"""The record schema and the fixed limits of the query surface."""

from pyspark.sql import DataFrame, types as T

# Level names in ascending severity (rank = position).
LEVELS = ("unknown", "trace", "debug", "info", "warn", "error")

# Bounds and defaults of a query.
DEFAULT_CAPACITY = 5_000
DEFAULT_RECORD_LIMIT = 100
DEFAULT_GROUP_LIMIT = 20
DEFAULT_CONTEXT_LINES = 8
DEFAULT_PAYLOAD_CHARS = 2_000
DEFAULT_TIMEOUT_MS = 30_000
DEFAULT_SETTLE_MS = 250
MAX_LIMIT = 1_000
MAX_CONTEXT_LINES = 50
MAX_PAYLOAD_CHARS = 10_000
MAX_TIMEOUT_MS = 120_000
FINGERPRINT_CHARS = 300
LAST_LINE_CHARS = 200
TAIL_LINES = 50

# Rows of the sequenced log that are handled together wherever an operator has
# to split the log by position. Groups keyed by (something, chunk) therefore
# never hold more than this many rows, however hot a source is.
CHUNK_ROWS = 1 << 20

LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)

LIFECYCLE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("detail", T.StringType()),
        T.StructField("changed_at", T.TimestampType(), False),
    ]
)


def timestamp_type(logs: DataFrame) -> str:
    """SQL name of the log's timestamp type (``timestamp`` or ``timestamp_ntz``)."""
    return logs.schema["timestamp"].dataType.simpleString()
