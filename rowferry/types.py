"""The six value types, the dynamic cell, and how Spark types fold into them."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.errors import ConfigError


class Kind(str, Enum):
    INTEGER = "integer"
    FLOAT = "float"
    TEXT = "text"
    BOOL = "bool"
    DATETIME = "datetime"
    DATE = "date"
    # A CSV cell: its type is known per row only, see CELL_TYPE.
    CELL = "cell"
    # The NULL constant.
    NULL = "null"

    @property
    def label(self) -> str:
        return {"datetime": "DateTime"}.get(self.value, self.value.capitalize())


VALUE_KINDS = (Kind.INTEGER, Kind.FLOAT, Kind.TEXT, Kind.BOOL, Kind.DATETIME, Kind.DATE)

SPARK_TYPE = {
    Kind.INTEGER: "bigint",
    Kind.FLOAT: "double",
    Kind.TEXT: "string",
    Kind.BOOL: "boolean",
    Kind.DATETIME: "timestamp_ntz",
    Kind.DATE: "date",
    Kind.NULL: "string",
}

# A cell keeps the sniffed type and the canonical text of the value.
CELL_TYPE = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]
)

_UNSET = object()


@dataclass(frozen=True)
class Value:
    """A Spark column with its kind; ``const`` holds the Python constant, if it is one."""

    column: Column
    kind: Kind
    const: Any = _UNSET

    @property
    def is_const(self) -> bool:
        return self.const is not _UNSET


def is_cell(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and [
        (f.name, f.dataType.simpleString()) for f in dtype.fields
    ] == [("kind", "string"), ("text", "string")]


def kind_of(dtype: T.DataType) -> Kind:
    """Kind of a column of any Spark type, as ``normalize_types`` would make it."""
    if is_cell(dtype):
        return Kind.CELL
    if isinstance(dtype, T.IntegralType):
        return Kind.INTEGER
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return Kind.FLOAT
    if isinstance(dtype, T.BooleanType):
        return Kind.BOOL
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return Kind.DATETIME
    if isinstance(dtype, T.DateType):
        return Kind.DATE
    return Kind.TEXT


def normalize_column(column: Column, dtype: T.DataType) -> Column:
    """Fold any Spark type into one of the six (or leave a cell as it is).

    Integers widen, decimals become doubles, zoned timestamps become UTC without
    a zone, nested values become JSON text, binary and intervals become NULL.
    Columns that already have the right type are passed through untouched, so
    the scan keeps its pushdown.
    """
    kind = kind_of(dtype)
    if kind is Kind.CELL:
        return column
    if isinstance(dtype, T.TimestampType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", F.unix_micros(column), epoch)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    if kind is Kind.TEXT and not isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        if dtype.typeName() == "variant":
            return F.to_json(column)
        if dtype.typeName().startswith("time"):
            return column.cast("string")
        return F.lit(None).cast("string")
    if dtype.simpleString() == SPARK_TYPE[kind]:
        return column
    return column.cast(SPARK_TYPE[kind])


def fit(column: Column, dtype: T.DataType, to: T.DataType) -> Column:
    """A value of one of the six types as the stored type of a target column.

    The way back from ``normalize_column``: date-times without a zone are UTC
    where the target stores instants.
    """
    if isinstance(to, T.TimestampType) and isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, column))
    return column.cast(to)


def normalize_types(df: DataFrame) -> DataFrame:
    """Every column of ``df`` in one of the six types; order and names are kept."""
    return df.select(
        *[normalize_column(F.col(_quoted(f.name)), f.dataType).alias(f.name) for f in df.schema]
    )


def values_of(df: DataFrame) -> dict[str, Value]:
    """Columns of a normalised frame by name."""
    out: dict[str, Value] = {}
    for field in df.schema:
        out[field.name] = Value(
            normalize_column(F.col(_quoted(field.name)), field.dataType), kind_of(field.dataType)
        )
    return out


def from_native_type(name: str | Column) -> Column:
    """Native type name of a database column -> kind, by the substring rules."""
    t = F.lower(name if isinstance(name, Column) else F.lit(name))

    def has(*words: str) -> Column:
        cond = F.contains(t, F.lit(words[0]))
        for word in words[1:]:
            cond = cond | F.contains(t, F.lit(word))
        return cond

    # The words looked for in a native type name, first match wins.
    return (
        F.when(has("bool") | (t == "bit"), F.lit("bool"))
        .when(has("int", "serial") | (t == "year"), F.lit("integer"))
        .when(has("decimal", "numeric", "real", "double", "float", "money"), F.lit("float"))
        .when(has("datetimeoffset"), F.lit("text"))
        .when(has("datetime", "timestamp"), F.lit("datetime"))
        .when(t == "date", F.lit("date"))
        .otherwise(F.lit("text"))
    )


def resolve_name(names: list[str], wanted: str, what: str) -> str:
    """Case-insensitive column lookup; unknown or doubtful names are errors."""
    hits = [n for n in names if n.lower() == wanted.lower()]
    if wanted in hits:
        return wanted
    if len(hits) == 1:
        return hits[0]
    if hits:
        raise ConfigError(f"{what}: column [{wanted}] is ambiguous: {', '.join(hits)}")
    raise ConfigError(f"{what} has no column [{wanted}] (available: {', '.join(names)})")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


quoted = _quoted
