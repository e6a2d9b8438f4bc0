"""Typing raw CSV text cell by cell, and voting a type per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.errors import ConfigError
from rowferry.functions.convert import parse_date, parse_datetime
from rowferry.functions.text import (
    FLOAT_PATTERN,
    INTEGER_PATTERN,
    PINNED,
    datetime_text,
    float_text,
    utrim,
)
from rowferry.types import Kind, kind_of, quoted

# Readings of trimmed text ``{t}``, as SQL: one text per column instead of
# hundreds of calls keeps wide files quick to plan. Looks at single characters
# come first, so most cells meet at most one pattern.
_STARTS_NUMERIC = "ascii({t}) between 43 and 57"
_CODED = "startswith({t}, '0') and length({t}) > 1 and substring({t}, 2, 1) <> '.'"  # 007
_INTEGER = f"""case when {_STARTS_NUMERIC} and not ({_CODED}) and {{t}} rlike r'{INTEGER_PATTERN}'
    then try_cast({{t}} as bigint) when not {PINNED} then 0 end"""
_FLOAT = f"""case when {{i}} is null and {_STARTS_NUMERIC} and not ({_CODED})
      and {{t}} rlike r'{FLOAT_PATTERN}' then nullif(abs(try_cast({{t}} as double)), double('inf'))
      * sign(try_cast({{t}} as double)) when not {PINNED} then 0 end"""
_DATED = f"""{{i}} is null and {_STARTS_NUMERIC} and octet_length({{t}}) >= 8
    and ascii(substring({{t}}, -1, 1)) between 48 and 57
    and (contains({{t}}, '/') or locate('-', {{t}}, 2) > 0)"""


def _pick(t: Column, i: Column, f: Column, d: Column, m: Column) -> Column:
    """The cell: integer, float, bool, date, date-time, else text; blank is NULL."""
    word = F.lower(t)
    return (
        F.when(t.isNull() | (t == ""), F.lit(None))
        .when(i.isNotNull(), _cell(Kind.INTEGER, i.cast("string")))
        .when(f.isNotNull(), _cell(Kind.FLOAT, float_text(f)))
        .when(d.isNotNull(), _cell(Kind.DATE, d.cast("string")))
        .when(m.isNotNull(), _cell(Kind.DATETIME, datetime_text(m)))
        .when(word.isin("true", "false"), _cell(Kind.BOOL, word))
        .when(F.expr(PINNED), _cell(Kind.TEXT, t))
    )


def _cell(kind: Kind, text: Column) -> Column:
    return F.struct(F.lit(kind.value).alias("kind"), text.alias("text"))


def sniff_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace raw text columns by cells; other columns pass through.

    Four narrow projections (trim, integer, other readings, pick) name each
    intermediate once. Unused columns are pruned from all of them.
    """
    chosen = set(columns if columns is not None else [
        f.name for f in df.schema if f.dataType.simpleString() == "string"
    ])
    temp = {n: f"__s{k}" for k, n in enumerate(df.columns) if n in chosen}
    passed = [F.col(quoted(n)) for n in df.columns if n not in chosen]
    dated = {s: F.expr(_DATED.format(t=s, i=s + "i")) for s in temp.values()}
    timed = {s: F.contains(F.col(s), F.lit(":")) for s in temp.values()}
    read = (
        df.select(*passed, *[utrim(F.col(quoted(n))).alias(s) for n, s in temp.items()])
        .select("*", *[F.expr(_INTEGER.format(t=s)).alias(s + "i") for s in temp.values()])
        .select(
            "*",
            *[F.expr(_FLOAT.format(t=s, i=s + "i")).alias(s + "f") for s in temp.values()],
            *[F.when(dated[s] & ~timed[s], parse_date(F.col(s))).alias(s + "d")
              for s in temp.values()],
            *[F.when(dated[s] & timed[s], parse_datetime(F.col(s))).alias(s + "m")
              for s in temp.values()],
        )
    )
    return read.select(
        *[
            _pick(*[F.col(temp[n] + part) for part in ("", "i", "f", "d", "m")]).alias(n)
            if n in temp
            else F.col(quoted(n))
            for n in df.columns
        ]
    )


def vote(kinds: Column) -> Column:
    """Type of a column from the set of kinds seen in it."""

    def only(*names: str) -> Column:
        return F.size(F.array_except(kinds, F.array(*[F.lit(n) for n in names]))) == 0

    return (
        F.when(F.size(kinds) == 0, F.lit(None).cast("string"))
        .when(F.size(kinds) == 1, F.element_at(kinds, 1))
        .when(only("integer", "float"), F.lit("float"))
        .when(only("date", "datetime"), F.lit("datetime"))
        .otherwise(F.lit("text"))
    )


def infer_types(
    df: DataFrame, sample: int | None = None, order_by: list[str] | None = None
) -> DataFrame:
    """``(index, name, inferred_type)``; NULL type when every value is NULL.

    The vote is one partial aggregate over at most six kind names per column and
    runs over the whole table. A ``sample`` takes the first rows of ``order_by``,
    which it needs, as a frame has no order of its own: n rows are kept per task
    and merged.
    """
    if sample is not None:
        if not order_by:
            raise ConfigError("the first rows of a sample need order_by")
        df = df.orderBy(*order_by).limit(sample)
    seen = []
    for i, field in enumerate(df.schema):
        c = F.col(quoted(field.name))
        kind = kind_of(field.dataType)
        label = c["kind"] if kind is Kind.CELL else F.when(c.isNotNull(), F.lit(kind.value))
        seen.append(F.collect_set(label).alias(f"k{i}"))
    voted = df.agg(*seen)
    rows = [
        F.struct(
            F.lit(i).alias("index"),
            F.lit(name).alias("name"),
            vote(F.col(f"k{i}")).alias("inferred_type"),
        )
        for i, name in enumerate(df.columns)
    ]
    return voted.select(F.inline(F.array(*rows)))
