"""Structured Streaming operators."""

from .follow import follow, follow_to, hydrate_and_follow, read_after, unique_by_seq
from .running import running_error_groups, running_source_stats
from .traces import follow_traces, open_traces, read_traces
from .unique import follow_unique, read_unique
from .wait import wait_for_logs

__all__ = [
    "follow", "follow_to", "follow_traces", "follow_unique", "hydrate_and_follow", "open_traces", "read_after", "read_traces", "read_unique",
    "running_error_groups", "running_source_stats", "unique_by_seq", "wait_for_logs",
]
