"""Row predicates: grep, source, severity, time and cursor, and the interactive filter.

Conjuncts are built cheapest first. ``seq`` and ``timestamp`` comparisons are plain column
comparisons with literals, so they reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.levels import parse_level_name
from ..functions.timeparse import instant_literal, parse_since
from ..schema import LEVELS, timestamp_type

_UNSUPPORTED = re.compile(
    r"\(\?(?:[=!>]|<[=!])"  # look-around, atomic groups
    r"|\\(?:[1-9]|k<)"  # back-references
    r"|\(\?[a-z]*[U]"  # swap-greed flag, which means something else here
)
# ASCII ranges of the bracketed character classes.
_ASCII_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_BIGGEST_SEQ = (1 << 63) - 1


def _bracket(pattern: str, at: int) -> tuple[str, int]:
    """The bracketed class that opens at ``at`` in Java's syntax, and the place after it.

    ``&&`` (intersection) means the same in both dialects, ``--`` (difference) becomes an
    intersection with a complement, ``~~`` (symmetric difference) is refused. A ``]`` right
    after the opening stands for itself.
    """
    out, i = ["["], at + 1
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    if pattern[i : i + 1] == "]":
        out.append("\\]")
        i += 1
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "]":
            return "".join(out) + "]", i + 1
        if c == "\\":
            out.append(two)
            i += 2
        elif named := re.match(r"\[:(\^?)([a-z]+):\]", pattern[i:]):
            if named[2] not in _ASCII_CLASSES:
                raise ValueError(f"no character class is named {named[2]!r}")
            out.append(f"[^{_ASCII_CLASSES[named[2]]}]" if named[1] else _ASCII_CLASSES[named[2]])
            i += len(named[0])
        elif c == "[":
            inner, i = _bracket(pattern, i)
            out.append(inner)
        elif two == "~~":
            raise ValueError("the symmetric difference of classes is not supported")
        elif two == "--" and len(out) > 1 and out != ["[", "^"]:
            # what stands before is one operand: [a--b] is [[a]&&[^b]], [^a--b] is [[^a]b]
            negated = out[1:2] == ["^"]
            first = "".join(out[2:] if negated else out[1:])
            rest, i = _operand(pattern, i + 2)
            if negated and (pattern[i : i + 1] != "]" or "[" in first):
                raise ValueError("a negated class may hold one difference of plain members")
            out = ["[", f"[^{first}]{rest}"] if negated else ["[", f"[{first}]&&{_complement(rest)}"]
        else:
            out.append(c)
            i += 1
    raise ValueError("a bracketed class is not closed")


def class_end(pattern: str, at: int) -> int:
    """The place after the bracketed class that opens at ``at``."""
    return _bracket(pattern, at)[1]


def _complement(members: str) -> str:
    """The class of all characters that are none of ``members`` (which may be one class in brackets)."""
    inner = members[1:-1] if members.startswith("[") and members.find("]") == len(members) - 1 else members
    if "[" in inner:
        raise ValueError("a difference of nested classes is not supported")
    return f"[{inner[1:]}]" if inner is not members and inner.startswith("^") else f"[^{inner}]"


def _operand(pattern: str, at: int) -> tuple[str, int]:
    """The members of a class up to the next set operator or the closing bracket."""
    out, i = [], at
    while i < len(pattern) and pattern[i] != "]" and pattern[i : i + 2] not in ("--", "&&", "~~"):
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        elif pattern[i] == "[":
            named = re.match(r"\[:(\^?)([a-z]+):\]", pattern[i:])
            inner, i = ("[" + pattern[i : i + len(named[0])] + "]", i + len(named[0])) if named else _bracket(pattern, i)
            out.append(_bracket(inner, 0)[0] if named else inner)
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out), i


def java_pattern(pattern: str) -> str:
    """A user pattern in the dialect of Spark's regular expressions.

    The accepted dialect is the linear-time one: Unicode classes, ``.`` excludes only ``\\n``,
    no look-around and no back-references (``ValueError``). Bracketed classes are translated.
    """
    out, outside, i = [], [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            step = pattern[i : i + 2]
            out.append(step)
            outside.append("" if step == "\\\\" else step)
            i += 2
        elif pattern[i] == "[":
            text, i = _bracket(pattern, i)
            out.append(text)
            outside.append("[]")
        else:
            out.append(pattern[i])
            outside.append(pattern[i])
            i += 1
    probe = "".join(outside)
    if _UNSUPPORTED.search(probe) or re.search(r"\\k<", probe):
        raise ValueError("look-around, back-references and the U flag are not supported")
    return "(?Ud)" + "".join(out).replace("(?P<", "(?<")


def check_pattern(pattern: str, name: str = "grep") -> str:
    """`java_pattern`, with a ``ValueError`` when Spark cannot compile the result.

    The probe is a query over one literal row.
    """
    try:
        text = java_pattern(pattern)
        SparkSession.active().sql("SELECT '' RLIKE :p AS ok", args={"p": text}).collect()
        return text
    except (PySparkException, ValueError) as error:
        raise ValueError(f"invalid `{name}` regex: {pattern!r} ({error})") from None


def payload_matches(pattern: str) -> Column:
    """Regex found anywhere in the payload (never in the source name)."""
    return F.col("payload").rlike(pattern)


def source_contains(text: str) -> Column:
    """Case-sensitive substring of the source name, taken literally."""
    return F.col("source").contains(text)


def min_level(level: str) -> Column:
    """At least this severe, as a set of names, which a Parquet scan can test on its own.

    ``unknown`` ranks lowest, so it passes no real level and lets every level pass.
    """
    rank = LEVELS.index(level)
    return F.lit(True) if rank == 0 else F.col("level").isin(*LEVELS[rank:])


def not_before(instant: datetime, type_name: str = "timestamp") -> Column:
    return F.col("timestamp") >= instant_literal(instant, type_name)


def after_cursor(cursor: int) -> Column:
    return F.col("seq") > cursor


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction; no condition means every row."""
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def log_filter(
    grep: str | None = None,
    source: str | None = None,
    level: str | None = None,
    since: str | None = None,
    cursor: int | None = None,
    *,
    on_error: str = "raise",
    as_of: datetime | None = None,
    type_name: str = "timestamp",
) -> Column:
    """The conjunction of the given conditions as one predicate.

    A malformed value raises ``ValueError`` before any job runs. With ``on_error="ignore"``
    a malformed pattern is dropped and the other conditions still apply.
    """
    conditions = []
    if cursor is not None:
        conditions.append(after_cursor(check_cursor(cursor)))
    if since is not None:
        conditions.append(not_before(parse_since(since, as_of), type_name))
    if source is not None:
        conditions.append(source_contains(source))
    if level is not None:
        name = parse_level_name(level)
        if name is None:
            raise ValueError(f"invalid `level`: {level!r} (expected trace|debug|info|warn|error)")
        if name != LEVELS[0]:
            conditions.append(min_level(name))
    if grep is not None:
        try:
            conditions.append(payload_matches(check_pattern(grep)))
        except ValueError:
            if on_error != "ignore":
                raise
    return all_of(conditions)


def check_cursor(cursor: int) -> int:
    if isinstance(cursor, bool) or not isinstance(cursor, int) or not 0 <= cursor <= _BIGGEST_SEQ:
        raise ValueError(f"invalid `cursor`: {cursor!r} (expected 0..={_BIGGEST_SEQ})")
    return cursor


def filter_logs(logs: DataFrame, **conditions) -> DataFrame:
    """Rows that pass `log_filter`. Works on batch and streaming logs alike."""
    return logs.where(log_filter(type_name=timestamp_type(logs), **conditions))


def interactive_filter(
    text: str = "",
    ignore_case: bool = False,
    sources: Iterable[str] | None = None,
    levels: Iterable[str] | None = None,
) -> Column:
    """What a person types while browsing: a pattern on payload or source.

    An invalid pattern is searched for as plain text without regard to case; empty text
    passes every row. ``sources`` and ``levels`` are exact sets, null meaning all.
    """
    conditions = []
    if sources is not None:
        conditions.append(F.col("source").isin(*sources) if (sources := list(sources)) else F.lit(False))
    if levels is not None:
        conditions.append(F.col("level").isin(*levels) if (levels := list(levels)) else F.lit(False))
    if text:
        payload, source = F.col("payload"), F.col("source")
        try:
            pattern = check_pattern(text)
            pattern = f"(?i){pattern}" if ignore_case else pattern
            conditions.append(payload.rlike(pattern) | source.rlike(pattern))
        except ValueError:
            wanted = text.lower()
            conditions.append(F.lower(payload).contains(wanted) | F.lower(source).contains(wanted))
    return all_of(conditions)
