"""DataFrame operators over the log."""

from .context import context_of, trailing_context
from .filters import filter_logs, interactive_filter, log_filter
from .groups import error_groups, newest_groups
from .horizon import cursor_gap, filtered_count, group_envelope, horizon, record_envelope, status
from .merge import dedup_by_seq, merge_sources
from .order import (
    assign_seq, burst_from, first_match_after, latest_match, newest, oldest, page_slice, retain_newest,
    settled_burst, tail_per_source, with_position,
)
from .stats import lifecycle_state, source_stats, source_totals, source_views

__all__ = [
    "assign_seq", "burst_from", "context_of", "cursor_gap", "dedup_by_seq", "error_groups", "filter_logs",
    "filtered_count", "first_match_after", "group_envelope", "horizon", "interactive_filter", "latest_match",
    "lifecycle_state", "log_filter", "merge_sources", "newest", "newest_groups", "oldest", "page_slice",
    "record_envelope", "retain_newest", "settled_burst", "source_stats", "source_totals", "source_views", "status",
    "tail_per_source", "trailing_context", "with_position",
]
