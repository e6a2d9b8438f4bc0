"""Rule-by-rule conversion with one reject per bad row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry import messages as M
from rowferry.errors import ConfigError
from rowferry.functions.convert import converted, failure
from rowferry.functions.stored import unfit
from rowferry.functions.text import pinned
from rowferry.types import Kind, Value, quoted, values_of

REJECT_COLUMNS = ("row", "column", "reason")


@dataclass(frozen=True)
class Rule:
    """Source column (by position) -> target column of a type; NULLs allowed or not."""

    source_index: int
    source_name: str
    target_column: str
    target_kind: Kind
    null_allowed: bool = True


FAILURE_TYPE = "struct<column:string,reason:string>"


def first_failure(failures: list[tuple[str, Column | None]]) -> Column:
    """``(column, reason)`` of the first failing column, NULL when none fails.

    Reasons of None stand for columns that cannot fail; if none can, the result
    is a constant and filters on it vanish from the plan.
    """
    tests = [
        F.when(
            reason.isNotNull() & pinned(),
            F.struct(F.lit(name).alias("column"), reason.alias("reason")),
        )
        for name, reason in failures
        if reason is not None
    ]
    return F.coalesce(*tests) if tests else F.lit(None).cast(FAILURE_TYPE)


def apply_rules(
    source: DataFrame, rules: list[Rule], row: str | None, keep: list[str] | None = None,
    stored: dict[str, T.StructField] | None = None,
) -> DataFrame:
    """Target columns plus ``__row`` and ``__fail``; every source row gives one row.

    ``row`` names the column with the source row number and is no part of the
    positions the rules count by.
    """
    if not rules:
        raise ConfigError("a mapping needs at least one rule")
    names = [c for c in source.columns if c != row and c not in (keep or [])]
    values = values_of(source)
    missing = Value(F.lit(None).cast("string"), Kind.NULL, None)
    operands = [
        (
            rule.target_column,
            rule.source_name,
            values[names[rule.source_index]] if 0 <= rule.source_index < len(names) else missing,
            rule.target_kind,
            rule.null_allowed,
        )
        for rule in rules
    ]
    number = F.col(quoted(row)) if row else F.lit(None)
    carried = [F.col(quoted(k)).alias(k) for k in keep or []]
    return convert_columns(source, operands, [*carried, number.cast("bigint").alias("__row")], stored)


def convert_columns(
    df: DataFrame,
    operands: list[tuple[str, str, Value, Kind, bool]],
    carried: list[Column],
    stored: dict[str, T.StructField] | None = None,
) -> DataFrame:
    """Converted columns, carried columns and ``__fail``.

    ``operands``: output name, name to report, value, kind, whether NULL is allowed.
    ``stored``: target columns by output name; values that they cannot hold fail.
    Two projections: the first converts, the second looks at the outcomes, so no
    value is converted twice and failures cost good rows nothing but NULL checks.
    """
    first, outputs, failures = [], [], []
    for k, (name, reported, v, kind, null_allowed) in enumerate(operands):
        same = v.kind is kind or v.kind is Kind.NULL
        done = F.col(f"__v{k}")
        first.append(converted(v, kind).alias(f"__v{k}"))
        raw = v
        if not same and kind is not Kind.TEXT:
            first.append(v.column.alias(f"__r{k}"))
            raw = Value(F.col(f"__r{k}"), v.kind)
        reason = failure(raw, kind, done)
        if not null_allowed:
            absent = done if same or kind is Kind.TEXT else raw.column
            missing = F.when(absent.isNull(), F.lit(M.NULL_NOT_ALLOWED))
            reason = missing if reason is None else missing.otherwise(reason)
        if stored and name in stored:
            narrow = unfit(done, kind, stored[name])
            if narrow is not None:
                reason = narrow if reason is None else F.coalesce(reason, narrow)
        outputs.append(done.alias(name))
        failures.append((reported, reason))
    kept = [f"__c{k}" for k in range(len(carried))]
    names = df.select(*carried).columns if carried else []
    step = df.select(*first, *[c.alias(n) for c, n in zip(carried, kept)])
    return step.select(
        *outputs,
        *[F.col(n).alias(name) for n, name in zip(kept, names)],
        first_failure(failures).alias("__fail"),
    )


def good_rows(tagged: DataFrame, columns: list[str]) -> DataFrame:
    return tagged.where(F.col("__fail").isNull()).select(*[F.col(quoted(c)) for c in columns])


def reject_rows(tagged: DataFrame) -> DataFrame:
    """``(row, column, reason)`` of the rows that failed."""
    return tagged.where(F.col("__fail").isNotNull()).select(
        F.col("__row").alias("row"),
        F.col("__fail")["column"].alias("column"),
        F.col("__fail")["reason"].alias("reason"),
    )


def auto_match(source: DataFrame, target_columns: list[str]) -> dict[str, str]:
    """Target column -> source column with the same name, case ignored, in source order."""
    by_name = {t.lower(): t for t in target_columns}
    matched: dict[str, str] = {}
    for name in source.columns:
        hit = by_name.get(name.lower())
        if hit is not None:
            matched[hit] = name
    return matched


def auto_rules(source: DataFrame, target: DataFrame) -> list[Rule]:
    """Rules for every name the two sides share; target types decide the conversion."""
    kinds = {name: v.kind for name, v in values_of(target).items()}
    matched = auto_match(source, target.columns)
    return [
        Rule(source.columns.index(src), src, tgt, kinds[tgt]) for tgt, src in matched.items()
    ]

