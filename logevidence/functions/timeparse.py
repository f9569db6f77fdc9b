"""The ``since`` argument: an RFC 3339 instant or an age such as ``30s``, ``5m``, ``2h``, ``1d``."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

_INSTANT = re.compile(
    r"(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?(?:([Zz])|([+-])(\d{2}):(\d{2}))",
    re.ASCII,
)
_AGE = re.compile(r"\+?(\d+)([smhd])", re.ASCII)
_SECONDS = {"s": 1, "m": 60, "h": 3_600, "d": 86_400}
_OLDEST = datetime(1, 1, 1, tzinfo=timezone.utc)
_LONGEST_AGE_DAYS = 95_000_000  # past this an age reaches beyond any representable calendar date


def parse_since(text: str, as_of: datetime | None = None) -> datetime:
    """The instant ``text`` names, in UTC; ``ValueError`` when it names none.

    Ages count back from ``as_of`` (now by default). Fractions finer than a microsecond
    round up, so that ``timestamp >= since`` keeps its meaning.
    """
    s = text.strip()
    instant = _instant(s)
    if instant is not None:
        return instant
    age = _AGE.fullmatch(s)
    if not age:
        raise ValueError(f"invalid `since`: {text!r} (expected RFC 3339 or 30s|5m|2h|1d)")
    seconds = int(age[1]) * _SECONDS[age[2]]
    if seconds > _LONGEST_AGE_DAYS * 86_400:
        raise ValueError(f"invalid `since`: {text!r} is out of range")
    now = as_of or datetime.now(timezone.utc)
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    try:
        return now.astimezone(timezone.utc) - timedelta(seconds=seconds)
    except OverflowError:
        return _OLDEST


def _instant(s: str) -> datetime | None:
    m = _INSTANT.fullmatch(s)
    if not m:
        return None
    year, month, day, hour, minute, second = (int(m[i]) for i in range(1, 7))
    digits = (m[7] or "").ljust(6, "0")
    micros = int(digits[:6]) + (1 if digits[6:].strip("0") else 0)
    offset = timedelta(0)
    if m[9]:
        offset = timedelta(hours=int(m[10]), minutes=int(m[11])) * (1 if m[9] == "+" else -1)
    try:
        if second > 60:
            return None
        base = datetime(year, month, day, hour, minute, min(second, 59), tzinfo=timezone.utc)
        return base + timedelta(seconds=max(second - 59, 0), microseconds=micros) - offset
    except (ValueError, OverflowError):
        return None


def since_instant(text: Column, as_of: Column | None = None) -> Column:
    """`parse_since` of every value of a column, as TIMESTAMP; null where a value names no instant.

    Ages count back from ``as_of`` (the time of the query by default).
    """
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    form = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?(?:[Zz]|([+-])(\d{2}):(\d{2}))$"
    part = lambda i: F.regexp_extract(s, form, i)
    number = lambda i: part(i).try_cast("int")
    second = number(6)
    base = F.try_make_timestamp(
        number(1), number(2), number(3), number(4), number(5), F.least(second, F.lit(59)).cast("decimal(16,6)"), F.lit("UTC")
    )
    finer = F.regexp_replace(F.substring(part(7), 7, 1 << 20), "0", "") != ""
    micros = F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("bigint") + finer.cast("int")
    offset = (number(9).cast("bigint") * 60 + number(10)) * 60_000_000 * F.when(part(8) == "-", -1).otherwise(1)
    leap = F.greatest(second - 59, F.lit(0)).cast("bigint") * 1_000_000
    instant = F.unix_micros(base) + F.coalesce(micros, F.lit(0)) + leap - F.coalesce(offset, F.lit(0))
    age = r"^\+?(\d+)([smhd])$"
    unit = F.regexp_extract(s, age, 2)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3_600).when(unit == "d", 86_400)
    count = F.regexp_extract(s, age, 1).try_cast("decimal(30,0)")
    seconds = F.when(count <= _LONGEST_AGE_DAYS * 86_400, count * size).cast("decimal(38,0)")
    oldest = F.lit(-62_135_596_800_000_000)
    back = F.unix_micros(F.current_timestamp() if as_of is None else as_of).cast("decimal(38,0)") - seconds * 1_000_000
    back = F.when(seconds <= _LONGEST_AGE_DAYS * 86_400, F.greatest(back, oldest)).cast("bigint")
    found = F.when(s.rlike(form) & (second <= 60), instant).when(s.rlike(age), back)
    return F.timestamp_micros(F.when(found >= oldest, found))


def instant_literal(instant: datetime, type_name: str = "timestamp") -> Column:
    """``instant`` as a literal of the log's own timestamp type.

    Matching the column's type matters: comparing across the two timestamp types would put
    a cast on the column and stop the comparison from reaching the Parquet scan.
    """
    utc = instant.astimezone(timezone.utc)
    text = utc.strftime("%Y-%m-%d %H:%M:%S.%f")
    text = text if utc.year >= 1000 else f"{utc.year:04d}" + text[text.index("-"):]
    return F.lit(text if type_name == "timestamp_ntz" else text + "Z").cast(type_name)
