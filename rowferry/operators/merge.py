"""Merging changes into a target table as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.operators.lookup import first_per_key, keyed_join, last_per_key, order_key
from rowferry.types import fit, quoted


def mark_matches(
    rows: DataFrame,
    row_keys: list[Column],
    target: DataFrame,
    target_keys: list[Column],
    salt: Column,
    name: str = "__match",
) -> DataFrame:
    """Add a flag: does the target hold this key? Only the target's keys are read."""
    names = [f"__ferry_k{i}" for i in range(len(target_keys))]
    known = distinct_keys(target, target_keys, names).withColumn(name, F.lit(True))
    joined = keyed_join(rows, row_keys, known, names, "left", salt)
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def distinct_keys(df: DataFrame, keys: list[Column], names: list[str]) -> DataFrame:
    out = df.select(*[k.alias(n) for k, n in zip(keys, names)])
    for n in names:
        out = out.where(F.col(n).isNotNull())
    return out.distinct()


def matched_rows(
    rows: DataFrame, row_keys: list[Column], target: DataFrame, target_keys: list[Column]
) -> DataFrame:
    """Rows whose key the target holds; rows without a key never match."""
    names = [f"__ferry_k{i}" for i in range(len(target_keys))]
    return keyed_join(rows, row_keys, distinct_keys(target, target_keys, names), names, "left_semi")


def unmatched_rows(
    rows: DataFrame, row_keys: list[Column], target: DataFrame, target_keys: list[Column],
    salt: Column,
) -> DataFrame:
    names = [f"__ferry_k{i}" for i in range(len(target_keys))]
    known = distinct_keys(target, target_keys, names)
    return keyed_join(rows, row_keys, known, names, "left_anti", salt)


def first_wins(
    rows: DataFrame, keys: list[Column], order_by: list[Column]
) -> DataFrame:
    """The first row of each complete key, and every row without one.

    Folding starts before the shuffle, so a hot key sends one row per task.
    Rows without a key are a group of their own each, also where their order ties.
    """
    complete = keys[0].isNotNull()
    for k in keys[1:]:
        complete = complete & k.isNotNull()
    names = [f"__g{i}" for i in range(len(keys))]
    folded = (
        rows.select(
            *[k.alias(n) for k, n in zip(keys, names)],
            F.when(~complete, F.monotonically_increasing_id()).alias("__solo"),
            F.struct(*[F.col(quoted(c)) for c in rows.columns]).alias("__v"),
            order_key(order_by).alias("__o"),
        )
        .groupBy(*names, "__solo")
        .agg(F.min_by("__v", "__o").alias("__v"))
    )
    return folded.select(*[F.col("__v")[c].alias(c) for c in rows.columns])


def apply_updates(
    target: DataFrame,
    target_keys: list[Column],
    changes: DataFrame,
    key_names: list[str],
    columns: list[str],
    hit: str | None = None,
) -> DataFrame:
    """Target with ``columns`` set from ``changes.__ferry_v`` where the key matches (at most one change).

    ``hit`` names a column with the number of changes that hit a row (``changes.__ferry_n``), NULL for untouched rows.
    """
    joined = keyed_join(target, target_keys, changes, key_names, "left", _own_salt(target))
    set_columns = {c.lower(): c for c in columns}
    changed = changes.schema["__ferry_v"].dataType
    out = []
    for field in target.schema:
        old = F.col(quoted(field.name))
        name = set_columns.get(field.name.lower())
        if name is not None:
            new = fit(F.col("__ferry_v")[name], changed[name].dataType, field.dataType)
            out.append(F.when(F.col("__ferry_v").isNotNull(), new).otherwise(old).alias(field.name))
        else:
            out.append(old.alias(field.name))
    return joined.select(*out, *([F.col("__ferry_n").alias(hit)] if hit else []))


def apply_deletes(
    target: DataFrame, target_keys: list[Column], keys: DataFrame, key_names: list[str]
) -> DataFrame:
    return keyed_join(target, target_keys, keys, key_names, "left_anti", _own_salt(target))


def apply_inserts(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows; columns they do not set are NULL, types are the target's."""
    given = {f.name.lower(): f for f in rows.schema}

    def stored(to):
        one = given.get(to.name.lower())
        if one is None:
            return F.lit(None).cast(to.dataType)
        return fit(F.col(quoted(one.name)), one.dataType, to.dataType)

    fitted = rows.select(*[stored(f).alias(f.name) for f in target.schema])
    return target.unionAll(fitted)


def _own_salt(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(quoted(c)) for c in df.columns])


__all__ = [
    "apply_deletes", "apply_inserts", "apply_updates", "distinct_keys", "first_per_key",
    "first_wins", "last_per_key", "mark_matches", "matched_rows", "unmatched_rows",
]
