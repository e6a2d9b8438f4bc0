"""Lookups: equality on match keys, at most one hit per source row.

The lookup side is reduced to its last row per key with a partial aggregate, so
a key that fills a third of the table is folded before the shuffle. Both sides
then join on a hash of the key plus the key itself. The hash serves two ends:
source rows without a key get a hash of their own and spread over all tasks,
and each side has its own exchange, which lets adaptive execution split skewed
partitions or switch to a broadcast once it knows the real size.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry import messages as M
from rowferry.errors import ConfigError
from rowferry.functions.exprs import Col, Expr, Scope, as_col
from rowferry.functions.predicates import All, Compare, comparable
from rowferry.functions.text import display_or_empty, key
from rowferry.types import Value, normalize_types, resolve_name, values_of


@dataclass
class Lookup:
    """A lookup table under an alias; ``on`` pairs a source operand with a lookup column."""

    alias: str
    table: DataFrame
    on: list[tuple[Expr, str]]
    order_by: list[str]
    how: str = "inner"
    columns: list[str] | None = field(default=None)

    def __post_init__(self):
        self.on = equality_pairs(self.on, self.alias)
        if self.how not in ("inner", "left"):
            raise ConfigError(f"lookup [{self.alias}]: how must be inner or left, not {self.how}")
        if not self.order_by:
            raise ConfigError(f"lookup [{self.alias}] needs order_by to tell the last duplicate")


def equality_pairs(on, alias: str) -> list[tuple[Expr, str]]:
    """``(source operand, column of alias)`` pairs from pairs or from ``==`` joined by ``&``."""
    if isinstance(on, (Compare, All)) or not isinstance(on, (list, tuple)):
        leaves = _conjuncts(on)
    else:
        leaves = []
        for item in on:
            if isinstance(item, tuple):
                leaves.append((as_col(item[0]), as_col(item[1])))
            else:
                leaves.extend(_conjuncts(item))
    pairs = []
    for left, right in leaves:
        left_own, right_own = _of_alias(left, alias), _of_alias(right, alias)
        if left_own == right_own:
            raise ConfigError(
                f"ON of [{alias}]: each equality needs one of its columns and one source value"
            )
        own, other = (left, right) if left_own else (right, left)
        pairs.append((other, own.column))
    if not pairs:
        raise ConfigError(f"[{alias}] has no ON condition")
    return pairs


def _conjuncts(condition) -> list[tuple[Expr, Expr]]:
    if isinstance(condition, All):
        return [pair for p in condition.parts for pair in _conjuncts(p)]
    if isinstance(condition, Compare) and condition.op == "==":
        return [(condition.left, condition.right)]
    raise ConfigError("ON takes equalities joined by &, nothing else")


def _of_alias(e: Expr, alias: str) -> bool:
    return isinstance(e, Col) and e.alias is not None and e.alias.lower() == alias.lower()


def order_key(columns: list[str] | list[Column]) -> Column:
    """Ordering value that is never NULL, so no row drops out of a min or max."""
    return F.struct(*columns)


def last_per_key(
    df: DataFrame, keys: dict[str, Column], values: list[Column], order_by: list, count: str | None = None
) -> DataFrame:
    """One row per complete key: ``__ferry_v``, the struct of the last row's values; ``count`` names their number."""
    return _fold(df, keys, values, order_by, F.max_by, count)


def first_per_key(
    df: DataFrame, keys: dict[str, Column], values: list[Column], order_by: list
) -> DataFrame:
    return _fold(df, keys, values, order_by, F.min_by)


def _fold(df, keys, values, order_by, pick, count=None) -> DataFrame:
    complete = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys.values()])
    return (
        df.where(complete)
        .select(
            *[k.alias(n) for n, k in keys.items()],
            F.struct(*values).alias("__v"),
            order_key(order_by).alias("__o"),
        )
        .groupBy(*keys)
        .agg(pick("__v", "__o").alias("__ferry_v"), *([F.count(F.lit(1)).alias(count)] if count else []))
    )


def spread_hash(keys: list[Column], salt: Column | None) -> Column:
    """Hash of a complete key; rows without one take ``salt`` and match nothing anyway."""
    complete = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    if salt is None:
        return F.xxhash64(*keys)
    return F.when(complete, F.xxhash64(*keys)).otherwise(salt)


def keyed_join(
    left: DataFrame,
    left_keys: list[Column],
    right: DataFrame,
    right_keys: list[str],
    how: str,
    salt: Column | None = None,
) -> DataFrame:
    """Join on hash and key; the helper columns of both sides are dropped."""
    names = [f"__l{i}" for i in range(len(left_keys))]
    probe = left.select(
        "*",
        *[k.alias(n) for n, k in zip(names, left_keys)],
        spread_hash(left_keys, salt).alias("__lh"),
    )
    build = right.select(
        *[F.col(k).alias(f"__r{i}") for i, k in enumerate(right_keys)],
        *[F.col(c) for c in right.columns if c not in right_keys],
        spread_hash([F.col(k) for k in right_keys], None).alias("__rh"),
    )
    on = F.col("__lh") == F.col("__rh")
    for i, n in enumerate(names):
        on = on & (F.col(n) == F.col(f"__r{i}"))
    joined = probe.join(build, on, how)
    extra = ["__lh", *names]
    if how not in ("left_semi", "left_anti"):
        extra += ["__rh", *[f"__r{i}" for i in range(len(names))]]
    return joined.drop(*extra)


def attach_lookup(
    df: DataFrame, scope: Scope, lookup: Lookup, salt: Column | None = None
) -> tuple[DataFrame, Scope, Column, Column]:
    """Left-join a lookup; returns frame, widened scope, hit flag and miss reason.

    Every source row stays: an inner miss is a reason (NULL when hit), so one
    pass yields good rows and rejects. Filtering on the hit flag lets the
    optimizer turn the join into an inner one.
    """
    table = normalize_types(lookup.table)
    own = values_of(table)
    what = f"lookup [{lookup.alias}]"
    probes = [e.bind(scope) for e, _ in lookup.on]
    key_names = [resolve_name(table.columns, c, what) for _, c in lookup.on]
    wanted = table.columns if lookup.columns is None else [
        resolve_name(table.columns, c, what) for c in lookup.columns
    ]
    sides = [comparable(p, own[k])[:2] for p, k in zip(probes, key_names)]
    values = [own[c].column.alias(f"c{i}") for i, c in enumerate(wanted)] or [F.lit(True).alias("c")]
    order = [F.col(f"`{o}`") for o in lookup.order_by]

    # Sides without a source column are conditions on the lookup alone.
    fixed = [i for i, (e, _) in enumerate(lookup.on) if not e.refs() and not e.whole_row()]
    for i in fixed:
        table = table.where(sides[i][0] == sides[i][1])
    keyed = [s for i, s in enumerate(sides) if i not in fixed]

    tag = f"__k{len(scope.aliases)}"
    if keyed:
        keys = {f"__ferry_k{i}": right for i, (_, right) in enumerate(keyed)}
        folded = last_per_key(table, keys, values, order).withColumnRenamed("__ferry_v", tag)
        joined = keyed_join(df, [left for left, _ in keyed], folded, list(keys), "left", salt)
    else:
        # One row answers all: a scalar, NULL where nothing is left.
        last = table.agg(F.max_by(F.struct(*values), order_key(order)).alias(tag))
        joined = df.select("*", last.scalar().alias(tag))
    columns = {
        c.lower(): Value(F.col(tag)[f"c{i}"], own[c].kind) for i, c in enumerate(wanted)
    }
    widened = Scope(
        scope.main, {**scope.aliases, lookup.alias.lower(): columns}, scope.source_row, scope.clock
    )
    if lookup.how == "left":
        return joined, widened, F.lit(True), F.lit(None).cast("string")
    shown = [display_or_empty(p) for p in probes]
    reason = F.concat(F.lit(M.LOOKUP_MISS.format(alias=lookup.alias)), F.concat_ws(", ", *shown))
    hit = F.col(tag).isNotNull()
    return joined, widened, hit, F.when(F.col(tag).isNull(), reason)


def lookup_duplicates(table: DataFrame, on: list[str]) -> DataFrame:
    """``(keys, duplicates)``: distinct complete keys and the rows hidden by a later one."""
    values = values_of(table)
    keys = {f"k{i}": key(values[resolve_name(table.columns, c, "lookup")]) for i, c in enumerate(on)}
    complete = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys.values()])
    counts = (
        table.where(complete)
        .groupBy(*[k.alias(n) for n, k in keys.items()])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )
