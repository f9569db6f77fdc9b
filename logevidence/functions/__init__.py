"""Scalar functions, all built-in Column expressions."""

from .fingerprint import fingerprint
from .jsonfmt import flatten_json, flattened_view, is_json
from .levels import detect_level, level_label, parse_level, severity, structured_level, text_level
from .text import clock_ms, elide, is_blank, preview, rfc3339, short_time, strip_line_ending, trim
from .timeparse import parse_since, since_instant

__all__ = [
    "clock_ms", "detect_level", "elide", "fingerprint", "flatten_json", "flattened_view", "is_blank", "is_json",
    "level_label", "parse_level", "parse_since", "preview", "rfc3339", "severity", "short_time", "since_instant",
    "strip_line_ending", "structured_level", "text_level", "trim",
]
