"""Does a converted value fit the stored type of its target column?"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry import messages as M
from rowferry.functions.text import display
from rowferry.types import Kind, Value

# The key under which Spark keeps the declared type of character columns.
_DECLARED = "__CHAR_VARCHAR_TYPE_STRING"
_LENGTH = re.compile(r"^(?:var)?char\(([0-9]+)\)$")
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}
_MOST_FLOAT = 3.4028234663852886e38


def most_characters(field: T.StructField) -> int | None:
    """The declared length of a character column."""
    if isinstance(field.dataType, (T.CharType, T.VarcharType)):
        return field.dataType.length
    found = _LENGTH.match(str((field.metadata or {}).get(_DECLARED, "")).lower())
    return int(found[1]) if found else None


def stored_name(field: T.StructField) -> str:
    length = most_characters(field)
    return field.dataType.simpleString() if length is None else f"varchar({length})"


def unfit(value: Column, kind: Kind, field: T.StructField) -> Column | None:
    """Why ``value``, of the column's kind, cannot be stored; None for columns that hold every value.

    Whole numbers and texts must be within range and length, decimals within
    their digits before the point (the others are rounded, half up), 32-bit
    floats within their range (they round as well).
    """
    to, length = field.dataType, most_characters(field)
    if kind is Kind.INTEGER and type(to) in _BITS:
        most = (1 << (_BITS[type(to)] - 1)) - 1
        bad = (value > most) | (value < -most - 1)
    elif kind is Kind.FLOAT and isinstance(to, T.FloatType):
        bad = (F.abs(value) > _MOST_FLOAT) & (F.abs(value) != float("inf")) & ~F.isnan(value)
    elif kind is Kind.FLOAT and isinstance(to, T.DecimalType):
        bad = value.isNotNull() & value.try_cast(to).isNull()
    elif kind is Kind.TEXT and length is not None:
        bad = F.length(value) > length
    else:
        return None
    shown = F.concat(F.lit(M.UNFIT[0]), display(Value(value, kind)), F.lit(M.UNFIT[1].format(type=stored_name(field))))
    return F.when(bad, shown)
