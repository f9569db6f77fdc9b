"""The user-level queries: validated arguments in, rows and an envelope out."""

from .kept import search_table, table_horizon, table_source_stats, table_source_totals, table_sources, table_status
from .queries import QueryArgs, Result, log_sources, log_status, recent_errors, records, search_logs
from .render import render_groups, render_records, render_sources, render_wait, to_json_lines

__all__ = [
    "QueryArgs", "Result", "log_sources", "log_status", "recent_errors", "records", "render_groups",
    "render_records", "render_sources", "render_wait", "search_logs", "search_table", "table_horizon", "table_source_stats",
    "table_source_totals", "table_sources", "table_status", "to_json_lines",
]
