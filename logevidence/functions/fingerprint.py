"""Fingerprints: the template of a line, with the parts that vary between occurrences replaced."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import FINGERPRINT_CHARS
from .text import WHITESPACE_CLASS, WHITESPACE_NOT_BLANK_CLASS

# A *run* is a maximal stretch of token characters. It is literal text up to its first digit,
# or up to a letter that begins an id reaching to the end of the run; from there to its end
# it is one variable part.
_TOKEN = "[0-9A-Za-z:._+\\-]"
_RUN_END = f"(?!{_TOKEN})"
_HEX = "[0-9a-fA-F]"
_UUID_TAIL = f"-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}[:._+]*+{_RUN_END}"
_NOT_COLON = "[0-9A-Za-z._+\\-]*+"
_NOT_DOT = "[0-9A-Za-z:_+\\-]*+"
_NOT_T = "[0-9A-SU-Za-z:._+\\-]*+"

# The longest quoted text that counts as one quoted part, in characters.
QUOTED_CHARS = 198

# Written before every variable part, then replaced together with it. A noncharacter, which
# interchanged text cannot contain.
_MARK = "\ufdd0"

_QUOTED = "(?=[\"'`])(?:" + "|".join(f"{q}[^{q}]{{0,{QUOTED_CHARS}}}+{q}" for q in "\"'`") + ")"

# Where a variable part begins: at the first digit of a run, at an id of letters and digits. The
# look-behind lets a stretch of hex letters be tried only where it begins.
_VARIABLE = (
    f"[0-9]{_TOKEN}*+|[a-fA-F]{_HEX}{{7}}(?:{_UUID_TAIL}|(?<![a-fA-F]{_HEX}{{8}}){_HEX}*+{_RUN_END})"
)

# The kinds of variable parts, most specific first. All begin with the mark, so they pass over
# everything else quickly.
_KINDS = (
    (f"{_MARK}{_HEX}{{8}}{_UUID_TAIL}", "<UUID>"),
    (f"{_MARK}(?:0x)*+{_HEX}{{8,}}+{_RUN_END}", "<HEX>"),
    (f"{_MARK}{_NOT_COLON}:{_NOT_COLON}:{_TOKEN}*+", "<TIME>"),
    (f"{_MARK}(?={_NOT_T}T)(?={_NOT_COLON}:){_TOKEN}*+", "<TS>"),
    (f"{_MARK}(?={_NOT_COLON}:|{_NOT_DOT}\\.{_NOT_DOT}\\.){_TOKEN}*+", "<ADDR>"),
    (f"{_MARK}{_TOKEN}++", "<N>"),
)

# White space to collapse: not a single blank, which already is what it would become.
_SPACE = f"(?![!-~])(?: {WHITESPACE_CLASS}++|{WHITESPACE_NOT_BLANK_CLASS}{WHITESPACE_CLASS}*+)"


def fingerprint(payload: Column) -> Column:
    """The displayed form of a line's `template`: its first ``FINGERPRINT_CHARS`` characters."""
    return shown(template(payload))


def shown(template: Column) -> Column:
    return F.substring(template, 1, FINGERPRINT_CHARS)


def template(payload: Column) -> Column:
    """Template of a line: ids, numbers, times, addresses and quoted text become placeholders.

    One scan replaces quoted text, one marks every variable part, one per kind replaces the
    marked parts (in lines that have any), one collapses white space. Every quantifier is
    possessive or bounded, so each scan is linear in the length of the line.
    """
    text = F.regexp_replace(payload, _QUOTED, "<S>")
    marked = F.regexp_replace(text, _VARIABLE, f"{_MARK}$0")
    named = marked
    for pattern, placeholder in _KINDS:
        named = F.regexp_replace(named, pattern, placeholder)
    text = F.when(F.contains(marked, F.lit(_MARK)), named).otherwise(marked)
    return F.trim(F.regexp_replace(text, _SPACE, " "))
