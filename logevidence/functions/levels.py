"""Severity: ranks, names, and inference from text and structured JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import LEVELS
from .jsonfmt import bind, json_fields, variant_kind
from .text import ltrim, trim

# Accepted spellings of each level name.
LEVEL_NAMES = {
    "trace": ("trace", "trc"),
    "debug": ("debug", "dbg"),
    "info": ("info", "inf"),
    "warn": ("warn", "warning", "wrn"),
    "error": ("error", "err", "fatal"),
    "unknown": ("unknown", "any", "all"),
}

# Extra spellings of "error" inside structured payloads.
CRITICAL_NAMES = ("critical", "crit", "emergency", "emerg", "alert")

# Top-level JSON keys that carry a level, in order of preference.
LEVEL_KEYS = ("level", "severity", "severity_text", "log_level", "loglevel", "log.level")

# Words that mark a failure, phrases that mark one, and phrases that deny one.
FAILURE_WORDS = (
    "err", "error", "errors", "fatal", "panic", "panicked", "exception", "failed", "failure", "traceback",
)
FAILURE_PHRASES = ("segmentation fault", "unhandled rejection", "uncaught exception")
CLEAN_PHRASES = (
    "0 error", "0 failure", "no error", "no failure", "without error", "error_count 0",
    "error_count=0", "errors: 0", "errors=0", "error-free", "failure-free",
)

# every key above contains one of these; `\\u` may hide a letter of it
_KEY_PATTERN = r"(?i)level|severity|\\u"

_START = "(?<![A-Za-z0-9_])"
_END = "(?![A-Za-z0-9_])"


def _any(words: tuple[str, ...]) -> str:
    return "(?i:" + "|".join(words) + ")"


def _initials(words: tuple[str, ...]) -> str:
    """A look-ahead for the first letters: most positions are dismissed by one table lookup."""
    letters = sorted({w[0] for w in words})
    return f"(?=[{''.join(letters)}{''.join(letters).upper()}])"


def _words(words: tuple[str, ...]) -> str:
    return f"{_initials(words)}{_START}{_any(words)}{_END}"


FAILURE_PATTERN = (
    f"{_words(FAILURE_WORDS)}|E(?:rror|xception){_END}|{_initials(FAILURE_PHRASES)}{_any(FAILURE_PHRASES)}"
)
CLEAN_PATTERN = _any(CLEAN_PHRASES)
# `warn` may be the beginning of a longer word, the others are whole words
WARN_PATTERN = f"(?=[wW]){_START}(?i:warn)"
LEVEL_WORDS = ("debug", "trace", "info")
ANY_LEVEL_PATTERN = f"(?=[dtiwDTIW]){_START}(?:(?i:warn)|{_any(LEVEL_WORDS)}{_END})"


def severity(level: Column) -> Column:
    """Rank of a level name: unknown 0, trace 1, debug 2, info 3, warn 4, error 5."""
    position = F.array_position(F.array(*map(F.lit, LEVELS)), level)
    return F.nullif(position, F.lit(0)).cast("int") - 1


def level_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1)


def _lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a literal map, else null. Refers to ``key`` once, however many entries there are."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


_BY_NAME = {name: level for level, names in LEVEL_NAMES.items() for name in names}
_BY_STRUCTURED_NAME = {**_BY_NAME, **dict.fromkeys(CRITICAL_NAMES, "error")}
# Syslog severities.
SYSLOG_LEVELS = {0: "error", 1: "error", 2: "error", 3: "error", 4: "warn", 5: "info", 6: "info", 7: "debug"}


def parse_level(c: Column) -> Column:
    """Level named by ``c`` (aliases, any case, surrounding blanks), else null."""
    return _lookup(_BY_NAME, F.lower(trim(c)))


def parse_level_name(text: str) -> str | None:
    """`parse_level` for one argument value."""
    return _BY_NAME.get(text.strip().lower())


def level_label(level: Column) -> Column:
    """Display form: upper case, cut or padded to five characters."""
    return F.rpad(F.upper(F.substring(level, 1, 5)), 5, " ")


def level_value(v: Column) -> Column:
    """Level carried by one JSON value: a name, or a syslog number 0-7."""
    kind = variant_kind(v)
    name = F.lower(trim(v.try_cast("string")))
    return F.when(kind == "STRING", _lookup(_BY_STRUCTURED_NAME, name)).when(
        kind == "BIGINT", _lookup(SYSLOG_LEVELS, v.try_cast("bigint").try_cast("int"))
    )


def structured_level(payload: Column) -> Column:
    """Level stated by a JSON object payload, else null.

    Keys are tried in the order of ``LEVEL_KEYS`` without regard to case; of several fields
    that differ only in case the one first in byte order is used. Last comes ``log.level``
    as a nested object. A value that is no level passes the turn to the next key.
    """

    def level_in(fields: Column) -> Column:
        def stated(keys: Column) -> Column:
            def at_key(name: Column) -> Column:
                first = F.array_min(F.filter(keys, lambda k: F.lower(k) == name))
                return bind(F.try_element_at(fields, first), level_value)

            return F.transform(F.array(*map(F.lit, LEVEL_KEYS)), at_key)

        keys = F.filter(F.map_keys(fields), lambda k: F.lower(k).isin(*LEVEL_KEYS))
        nested = F.try_element_at(fields, F.lit("log")).try_cast("map<string,variant>")
        return F.coalesce(
            F.try_element_at(F.filter(bind(keys, stated), lambda x: x.isNotNull()), F.lit(1)),
            bind(F.try_element_at(nested, F.lit("level")), level_value),
        )

    # only a text that spells out one of the keys, or spells something in escapes, is worth parsing
    candidate = ltrim(payload).startswith("{") & payload.rlike(_KEY_PATTERN)
    return F.when(candidate, bind(json_fields(payload), level_in))


def text_level(payload: Column) -> Column:
    """Level read from the words of a line; ``unknown`` when no word names one.

    A line without any such word costs two scans; only the others are looked at again.
    """
    failed = payload.rlike(FAILURE_PATTERN) & ~payload.rlike(CLEAN_PATTERN)
    case = (
        F.when(failed, "error")
        .when(~payload.rlike(ANY_LEVEL_PATTERN), "unknown")
        .when(payload.rlike(WARN_PATTERN), "warn")
    )
    for level in LEVEL_WORDS:
        case = case.when(payload.rlike(_words((level,))), level)
    return case.otherwise("unknown")


def detect_level(payload: Column) -> Column:
    """Structured level if the payload states one, else the text level."""
    return F.coalesce(structured_level(payload), text_level(payload))
