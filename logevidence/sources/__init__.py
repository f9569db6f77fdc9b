"""Readers and writers of log records."""

from .config import parse_config, sources_from_config
from .grams import index_grams
from .lines import from_lines, read_containers, read_lines, read_process_output
from .log_table import append_batch, append_logs, compact, compact_in_place, evict, read_log_table, vacuum
from .records import read_records, write_records
from .summaries import read_counters

__all__ = [
    "append_batch", "append_logs", "compact", "compact_in_place", "evict", "from_lines", "index_grams", "parse_config", "read_containers", "read_lines",
    "read_counters", "read_log_table", "read_process_output", "read_records", "vacuum", "sources_from_config", "write_records",
]
