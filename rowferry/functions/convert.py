"""Strict conversion into the six types: a value, or the reason why not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowferry import messages as M
from rowferry.functions.text import (
    display,
    is_whole,
    text_to_float,
    text_to_integer,
    utrim,
)
from rowferry.types import SPARK_TYPE, VALUE_KINDS, Kind, Value

# Accepted date and date-time spellings. Both separators must be
# the same; the ``T`` form needs dashes and seconds; seconds are optional
# after a space.
_DATE = r"[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,2}"
_SIGNED_DATE = r"[+-][0-9]{1,6}-[0-9]{1,2}-[0-9]{1,2}|[+-][0-9]{1,6}/[0-9]{1,2}/[0-9]{1,2}"
_TIME = r"[0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2})?"
DATE_PATTERN = rf"^(?:{_DATE}|{_SIGNED_DATE})$"
DATETIME_PATTERN = (
    rf"^(?:(?:{_DATE}|{_SIGNED_DATE}) +{_TIME}"
    r"|[+-]?[0-9]{1,6}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})$"
)
# The spellings most data uses: casts take them after one character replacement.
_USUAL_DATE = r"[0-9]{4}(?:-[0-9]{1,2}-|/[0-9]{1,2}/)[0-9]{1,2}"
USUAL_DATE_PATTERN = rf"^{_USUAL_DATE}$"
USUAL_DATETIME_PATTERN = (
    rf"^(?:{_USUAL_DATE} {_TIME}"
    r"|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})$"
)


def _dashed(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("/")), F.translate(text, "/", "-")).otherwise(text)


def _padded_year(text: Column) -> Column:
    """Dashes only, single blanks, and a year of at least four digits, as casts want it."""
    padded = F.regexp_replace(_dashed(text), "^([+-]?)([0-9]{1,4}-)", "$1000$2")
    four = F.regexp_replace(padded, "^([+-]?)0{1,3}([0-9]{4})", "$1$2")
    return F.regexp_replace(four, " +", " ")


def parse_date(trimmed: Column) -> Column:
    return F.when(
        trimmed.rlike(USUAL_DATE_PATTERN), _dashed(trimmed).try_cast("date")
    ).when(trimmed.rlike(DATE_PATTERN), _padded_year(trimmed).try_cast("date"))


def parse_datetime(trimmed: Column) -> Column:
    """A date-time spelling, or a bare date as midnight."""
    return F.when(
        trimmed.rlike(USUAL_DATETIME_PATTERN) | trimmed.rlike(USUAL_DATE_PATTERN),
        _dashed(trimmed).try_cast("timestamp_ntz"),
    ).when(
        trimmed.rlike(DATETIME_PATTERN) | trimmed.rlike(DATE_PATTERN),
        _padded_year(trimmed).try_cast("timestamp_ntz"),
    )


def _around(parts: tuple[str, str], shown: Column) -> Column:
    return F.concat(F.lit(parts[0]), shown, F.lit(parts[1]))


def convert(v: Value, target: Kind) -> tuple[Column, Column]:
    """``(value, reason)``: reason is NULL when the value converts (NULL always does)."""
    value = converted(v, target)
    reason = failure(v, target, value)
    return value, F.lit(None).cast("string") if reason is None else reason


def converted(v: Value, target: Kind) -> Column:
    """The value in the target's type; NULL if it is NULL or does not convert."""
    c, kind = v.column, v.kind
    if kind is Kind.CELL:
        return _by_cell_kind(c, target)
    if kind is target:
        return c
    if target is Kind.TEXT:
        return display(v)
    if (kind, target) in _READERS:
        return _READERS[kind, target][0](c)
    return F.lit(None).cast(SPARK_TYPE[target])


def failure(v: Value, target: Kind, value: Column) -> Column | None:
    """Why ``value`` is NULL although ``v`` is not; None for pairs that cannot fail.

    Takes the converted value as an argument so that a projection above the
    conversion can look at the outcome instead of converting again.
    """
    c, kind = v.column, v.kind
    if kind is target or target is Kind.TEXT or kind is Kind.NULL:
        return None
    if kind is Kind.CELL:
        reason = F.when(F.lit(False), F.lit(None).cast("string"))
        for k in VALUE_KINDS:
            why = _reason(cell_as(c, k), k, target)
            if why is not None:
                reason = reason.when(c["kind"] == k.value, why)
    else:
        reason = _reason(v, kind, target)
        if reason is None:
            return None
    return F.when(c.isNotNull() & value.isNull(), reason)


def _reason(v: Value, kind: Kind, target: Kind) -> Column | None:
    """Text for a value known not to convert."""
    if kind is target or target is Kind.TEXT:
        return None
    if (kind, target) not in _READERS:
        return F.lit(M.UNSUPPORTED.format(source=kind.label, target=target.label))
    parts = _READERS[kind, target][1]
    return None if parts is None else _around(parts, display(v))


def _int_as_bool(c: Column) -> Column:
    return F.when(c == 0, F.lit(False)).when(c == 1, F.lit(True))


def _text_as_bool(c: Column) -> Column:
    word = F.lower(utrim(c))
    return F.when(word.isin("true", "1"), F.lit(True)).when(
        word.isin("false", "0"), F.lit(False)
    )


# How each pair of kinds converts, and the text around a value that does not.
# Pairs that are not here (and are neither equal nor to text) are unsupported.
_READERS = {
    (Kind.FLOAT, Kind.INTEGER): (
        lambda c: F.when(is_whole(c), c.try_cast("bigint")), M.INT_FROM_FLOAT),
    (Kind.TEXT, Kind.INTEGER): (lambda c: text_to_integer(utrim(c)), M.INT_FROM_TEXT),
    (Kind.BOOL, Kind.INTEGER): (lambda c: c.cast("bigint"), None),
    (Kind.INTEGER, Kind.FLOAT): (lambda c: c.cast("double"), None),
    (Kind.TEXT, Kind.FLOAT): (lambda c: text_to_float(utrim(c)), M.FLOAT_FROM_TEXT),
    (Kind.INTEGER, Kind.BOOL): (_int_as_bool, M.BOOL_FROM_INT),
    (Kind.TEXT, Kind.BOOL): (_text_as_bool, M.BOOL_FROM_TEXT),
    (Kind.DATE, Kind.DATETIME): (lambda c: c.cast("timestamp_ntz"), None),
    (Kind.TEXT, Kind.DATETIME): (lambda c: parse_datetime(utrim(c)), M.DATETIME_FROM_TEXT),
    (Kind.DATETIME, Kind.DATE): (lambda c: c.cast("date"), None),
    (Kind.TEXT, Kind.DATE): (lambda c: parse_date(utrim(c)), M.DATE_FROM_TEXT),
}


def cell_as(cell: Column, kind: Kind) -> Value:
    """The value of a cell whose kind is already known to be ``kind``."""
    text = cell["text"]
    return Value(text if kind is Kind.TEXT else text.try_cast(SPARK_TYPE[kind]), kind)


def _by_cell_kind(c: Column, target: Kind) -> Column:
    if target is Kind.TEXT:
        return c["text"]
    value = F.when(F.lit(False), F.lit(None).cast(SPARK_TYPE[target]))
    for kind in VALUE_KINDS:
        if kind is target or (kind, target) in _READERS:
            value = value.when(c["kind"] == kind.value, converted(cell_as(c, kind), target))
    return value
