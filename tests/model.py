"""Brute-force models in plain Python that the Spark operators are compared with."""

from __future__ import annotations

import re

SPACE = re.compile(r"\s")
_PIECE = re.compile(r"""("[^"]{0,198}")|('[^']{0,198}')|(`[^`]{0,198}`)|([0-9A-Za-z:._+\-]+)|(\s+)|(.)""", re.S)
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}[:._+]*")
_HEX = re.compile(r"(0x)*[0-9a-fA-F]{8,}")


def _part(token: str) -> str:
    if _UUID.fullmatch(token):
        return "<UUID>"
    if _HEX.fullmatch(token):
        return "<HEX>"
    colons, dots = token.count(":"), token.count(".")
    if colons >= 2:
        return "<TIME>"
    if colons and "T" in token:
        return "<TS>"
    return "<ADDR>" if dots >= 2 or colons else "<N>"


def _run(run: str) -> str:
    for i, ch in enumerate(run):
        rest = run[i:]
        if ch in "0123456789":
            return run[:i] + _part(rest)
        if ch in "abcdefABCDEF" and (_UUID.fullmatch(rest) or _HEX.fullmatch(rest)):
            return run[:i] + _part(rest)
    return run


def fingerprint(text: str) -> str:
    out = []
    for double, single, back, run, blank, other in _PIECE.findall(text):
        if double or single or back:
            out.append("<S>")
        elif run:
            out.append(_run(run))
        else:
            out.append(" " if blank else other)
    return "".join(out).strip()[:300]


def starts_event(row) -> bool:
    return row["level"] != "unknown" or not row["payload"].strip()


def context(rows: list[dict], at: int, n: int) -> list[str]:
    """Continuation lines after rows[at]."""
    later = [r for r in rows[at + 1:] if r["source"] == rows[at]["source"]]
    stop = next((i for i, r in enumerate(later) if starts_event(r)), len(later))
    return [r["payload"] for r in later[:stop][:n]]
