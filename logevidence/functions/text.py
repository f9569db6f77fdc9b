"""Text helpers: trimming, shortening, clock times, record timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_OTHER_SPACE = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE_CLASS = f"[ {_OTHER_SPACE}]"
WHITESPACE_NOT_BLANK_CLASS = f"[{_OTHER_SPACE}]"


def trim(c: Column) -> Column:
    """Strip Unicode white space from both ends (Spark's own trim strips blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def ltrim(c: Column) -> Column:
    """Strip white space from the start only; unlike `trim` it stops at the first other character."""
    return F.ltrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return ltrim(c) == ""


def elide(c: Column, max_chars: int) -> tuple[Column, Column]:
    """Cut to ``max_chars`` code points, saying how many were dropped.

    Returns the shortened text and the original length (null where nothing was cut).
    """
    length = F.char_length(c)
    cut = length > max_chars
    marker = F.concat(F.lit("… [+"), (length - max_chars).cast("string"), F.lit(" chars]"))
    return (
        F.when(cut, F.concat(F.substring(c, 1, max_chars), marker)).otherwise(c),
        F.when(cut, length.cast("bigint")),
    )


def preview(c: Column, max_chars: int) -> Column:
    """One line of at most ``max_chars`` characters, ``…`` marking a cut."""
    flat = F.translate(c, "\n\r", "  ")
    return F.when(
        F.char_length(flat) > max_chars, F.concat(F.substring(flat, 1, max_chars), F.lit("…"))
    ).otherwise(flat)


def short_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm:ss"), F.lit("?"))


def clock_ms(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def rfc3339(ts: Column) -> Column:
    """UTC timestamp text with as many fraction digits (0, 3 or 6) as the value needs."""
    micros = F.date_format(ts, "SSSSSS")
    fraction = (
        F.when(micros == "000000", F.lit(""))
        .when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3)))
        .otherwise(F.concat(F.lit("."), micros))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def pad_right(c: Column, width: int | Column) -> Column:
    """Pad with blanks to ``width``; longer text is kept whole (``rpad`` would cut it)."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(width - F.char_length(c), F.lit(0))))


def pad_left(c: Column, width: int) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.char_length(c), F.lit(0))), c)


def strip_line_ending(c: Column, kind: str = "file") -> Column:
    """Remove the line ending a source of this kind leaves on a line.

    ``file`` drops every trailing CR/LF, ``container`` every trailing LF,
    ``lines`` (piped or captured output) a single LF or CRLF.
    """
    pattern = {"file": r"[\r\n]+\z", "container": r"\n+\z", "lines": r"\r?\n\z"}[kind]
    return F.regexp_replace(c, pattern, "")
