"""Trimming, canonical text, match keys and numeric reading of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowferry.types import Kind, Value

# The characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Accepted spellings of numbers (ASCII digits only).
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
INFINITY_WORDS = ("inf", "+inf", "infinity", "+infinity")
MINUS_INFINITY_WORDS = ("-inf", "-infinity")
NAN_WORDS = ("nan", "+nan", "-nan")

# Always true, see ``pinned``.
PINNED = "exists(array(spark_partition_id()), p -> p >= 0)"

_TWO_53 = float(2**53)
_TWO_63 = float(2**63)


def utrim(text: Column) -> Column:
    """Trim Unicode white space; Spark's plain ``trim`` only strips U+0020.

    Text that begins and ends with a visible ASCII character is left alone,
    which spares most values the set-based trim.
    """
    first, last = F.ascii(text), F.ascii(F.substring(text, -1, 1))
    visible = (first > 32) & (first < 127) & (last > 32) & (last < 127)
    return F.when(visible, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def pinned() -> Column:
    """Always true, but opaque to the optimizer.

    A projection that mentions it is computed where it stands: filters on its
    outcome are not copied below it. Without that, a filter on the outcome of a
    conversion would carry the whole conversion down to the scan and run it twice.

    The lambda also keeps that one projection out of the fused loop of its
    stage. A mapping of many columns fused into one loop body outgrows what the
    JIT compiles; on its own it is generated as many small methods.
    """
    return F.expr(PINNED)


def is_whole(x: Column) -> Column:
    """True for finite doubles without a fraction (NaN and infinities give NaN % 1)."""
    return (x % F.lit(1.0)) == F.lit(0.0)


def _unusual_float_text(x: Column) -> Column:
    """Zeros, NaN, infinities, and sizes that Spark's cast writes with an exponent.

    ``%f`` with enough places pads the shortest digits with zeros; these are cut off.
    """
    places = F.when(F.abs(x) >= F.lit(1.0), F.format_string("%.20f", x)).otherwise(
        F.format_string("%.345f", x)
    )
    return (
        F.when(F.isnan(x), F.lit("NaN"))
        .when(x == F.lit(float("inf")), F.lit("inf"))
        .when(x == F.lit(float("-inf")), F.lit("-inf"))
        .otherwise(F.rtrim(F.rtrim(places, F.lit("0")), F.lit(".")))
    )


def float_text(x: Column) -> Column:
    """Shortest digits of a double, never with an exponent or a trailing ``.0``.

    Everyday values, whole or between 1e-3 and 1e7, take two plain casts.
    """
    size = F.abs(x)
    return (
        F.when(
            is_whole(x) & (size < F.lit(_TWO_53)) & (x != F.lit(0.0)),
            x.try_cast("bigint").cast("string"),
        )
        .when((size >= F.lit(1e-3)) & (size < F.lit(1e7)), x.cast("string"))
        .when(x.isNotNull(), _unusual_float_text(x))
    )


def datetime_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` without a zone round trip; fractions are dropped."""
    return F.substring_index(ts.cast("string"), ".", 1)


def display(v: Value) -> Column:
    """Text form of a value, NULL for NULL."""
    c = v.column
    if v.kind is Kind.CELL:
        return c["text"]
    if v.kind is Kind.FLOAT:
        return float_text(c)
    if v.kind is Kind.DATETIME:
        return datetime_text(c)
    if v.kind in (Kind.TEXT, Kind.NULL):
        return c
    return c.cast("string")


def display_or_empty(v: Value) -> Column:
    return F.coalesce(display(v), F.lit(""))


def _float_key(x: Column, text: Column) -> Column:
    whole = is_whole(x) & (F.abs(x) < F.lit(_TWO_63))
    return F.when(whole, x.try_cast("bigint").cast("string")).otherwise(text)


def key(v: Value) -> Column:
    """Match key: equal keys mean equal values; NULL and blank text have none."""
    c = v.column
    if v.kind is Kind.TEXT:
        return F.nullif(F.lower(utrim(c)), F.lit(""))
    if v.kind is Kind.FLOAT:
        return _float_key(c, float_text(c))
    if v.kind is Kind.CELL:
        return (
            F.when(c["kind"] == "text", F.nullif(F.lower(utrim(c["text"])), F.lit("")))
            .when(c["kind"] == "float", _float_key(c["text"].try_cast("double"), c["text"]))
            .otherwise(c["text"])
        )
    return display(v)


def starts_numeric(trimmed: Column) -> Column:
    """First character is a digit, a sign or a point: everything else skips the parsers."""
    code = F.ascii(trimmed)
    return (code >= 43) & (code <= 57)


def ends_in_digit(trimmed: Column) -> Column:
    return F.ascii(F.substring(trimmed, -1, 1)).between(48, 57)


def text_to_float(trimmed: Column) -> Column:
    """Strict double reading of trimmed text; NULL when it is not a number."""
    word = F.lower(trimmed)
    return (
        F.when(
            starts_numeric(trimmed) & trimmed.rlike(FLOAT_PATTERN), trimmed.try_cast("double")
        )
        .when(word.isin(*NAN_WORDS), F.lit(float("nan")))
        .when(word.isin(*INFINITY_WORDS), F.lit(float("inf")))
        .when(word.isin(*MINUS_INFINITY_WORDS), F.lit(float("-inf")))
    )


def text_to_integer(trimmed: Column) -> Column:
    """Strict 64-bit reading of trimmed text; NULL when it is not an integer.

    The pattern goes first: a cast that fails costs an exception per row.
    """
    return F.when(
        starts_numeric(trimmed) & trimmed.rlike(INTEGER_PATTERN), trimmed.try_cast("bigint")
    )


def num(v: Value) -> Column:
    """Numeric reading used by order comparisons; booleans and dates are no numbers."""
    if v.kind in (Kind.INTEGER, Kind.FLOAT):
        return v.column.cast("double")
    if v.kind is Kind.TEXT:
        return text_to_float(utrim(v.column))
    if v.kind is Kind.CELL:
        c = v.column
        return F.when(c["kind"].isin("integer", "float"), c["text"].try_cast("double")).when(
            c["kind"] == "text", text_to_float(utrim(c["text"]))
        )
    return F.lit(None).cast("double")
