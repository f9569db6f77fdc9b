"""JSON payloads: strict recognition and one-line flattening."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import ltrim, trim


# Ends the array that a payload is parsed in. A noncharacter, which interchanged text cannot contain.
_LAST = "\ufdd0"


def variant_kind(v: Column) -> Column:
    """Type name of a variant value, e.g. ``STRING``, ``BIGINT``, ``DECIMAL(2,1)``, ``VOID``."""
    return F.schema_of_variant(v)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _strict(doc: Column) -> Column:
    """``doc`` parsed as exactly one JSON value, else null.

    The variant parser stops after the first value and ignores what follows. So the text is
    parsed as the first of two elements of an array: with anything after the value in ``doc``
    the array does not come out as those two.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), doc, F.lit(f',"{_LAST}"]'))).try_cast("array<variant>")

    def first(elements: Column) -> Column:
        whole = (F.size(elements) == 2) & (F.try_element_at(elements, F.lit(2)).try_cast("string") == _LAST)
        return F.when(whole, F.try_element_at(elements, F.lit(1)))

    return bind(pair, first)


def json_fields(payload: Column) -> Column:
    """``map<string,variant>`` of a payload that is a JSON object, else null."""
    return _strict(trim(payload)).try_cast("map<string,variant>")


def _looks_like_json(payload: Column) -> Column:
    return F.substring(ltrim(payload), 1, 1).isin("{", "[")


def is_json(payload: Column) -> Column:
    doc = trim(payload)
    return F.when(_looks_like_json(payload), _strict(doc).isNotNull()).otherwise(False)


def flatten_json(payload: Column) -> Column:
    """``k=v`` pairs of an object in byte order of the keys, two blanks between them.

    Strings are bare, nested values compact JSON. An array becomes compact JSON; anything
    else gives null.
    """
    doc = trim(payload)

    def flat(value: Column) -> Column:
        pairs = F.array_sort(F.map_entries(value.try_cast("map<string,variant>")), _by_key)
        parts = F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), bind(e["value"], _plain)))
        return F.when(ltrim(payload).startswith("{"), F.array_join(parts, "  ")).otherwise(F.to_json(value))

    return F.when(_looks_like_json(payload), bind(_strict(doc), flat))


def flattened_view(payload: Column) -> Column:
    """The flattened form of a JSON payload, any other payload as it is."""
    return F.coalesce(flatten_json(payload), payload)


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def _plain(v: Column) -> Column:
    kind = variant_kind(v)
    number = v.try_cast("double")
    # fractional numbers print as the shortest double; outside this range Spark would switch to an exponent
    fractional = kind.rlike(r"^(DECIMAL\((?:[1-9]|1[0-8]),|DOUBLE|FLOAT)") & (
        (F.abs(number) >= 1e-3) & (F.abs(number) < 1e7) | (number == 0)
    )
    return (
        F.when(kind == "STRING", v.try_cast("string"))
        .when(kind == "VOID", F.lit("null"))
        .when(fractional, number.cast("string"))
        .otherwise(F.to_json(v))
    )
