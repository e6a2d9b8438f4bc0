"""Two-valued predicates over normalised values.

Semantics work on match keys: text compares trimmed and without case, NULL
equals NULL and blank text, a number compares with numeric text. No predicate is
ever NULL, so ``NOT`` is plain negation.

A condition is bound with the outcome it is wanted for. Where both sides have
the same primitive type, the native comparison is emitted, so the filter still
reaches the Parquet or JDBC scan; negation is pushed to the leaves for the same
reason. Text dates against date columns get native ranges as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowferry.functions.exprs import Col, Expr, Scope, as_col, as_const
from rowferry.functions.text import display_or_empty, key, num, utrim
from rowferry.types import Kind, Value

_OPS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}
_OPPOSITE = {">": "<=", "<": ">=", ">=": "<", "<=": ">"}
_MIRRORED = {">": "<", "<": ">", ">=": "<=", "<=": ">="}
_NATIVE = (Kind.INTEGER, Kind.BOOL, Kind.DATE)
_NUMBERS = (Kind.INTEGER, Kind.FLOAT)


class Condition:
    """A predicate tree; combine with ``&``, ``|`` and ``~``."""

    def refs(self) -> list[Col]:
        return []

    def bind(self, scope: Scope, want: bool = True) -> Column:
        """A column that is true exactly when the condition has the wanted outcome.

        In other cases it is false or NULL, which a filter drops alike.
        """
        raise NotImplementedError

    def whole_row(self) -> bool:
        return False

    def __and__(self, other: "Condition") -> "Condition":
        return All((self, other))

    def __or__(self, other: "Condition") -> "Condition":
        return AnyOf((self, other))

    def __invert__(self) -> "Condition":
        return Not(self)


@dataclass(frozen=True)
class All(Condition):
    parts: tuple[Condition, ...]

    def refs(self):
        return [r for p in self.parts for r in p.refs()]

    def whole_row(self):
        return any(p.whole_row() for p in self.parts)

    def bind(self, scope, want=True):
        bound = [p.bind(scope, want) for p in self.parts]
        return reduce((lambda a, b: a & b) if want else (lambda a, b: a | b), bound)


@dataclass(frozen=True)
class AnyOf(Condition):
    parts: tuple[Condition, ...]

    def refs(self):
        return [r for p in self.parts for r in p.refs()]

    def whole_row(self):
        return any(p.whole_row() for p in self.parts)

    def bind(self, scope, want=True):
        bound = [p.bind(scope, want) for p in self.parts]
        return reduce((lambda a, b: a | b) if want else (lambda a, b: a & b), bound)


@dataclass(frozen=True)
class Not(Condition):
    inner: Condition

    def refs(self):
        return self.inner.refs()

    def whole_row(self):
        return self.inner.whole_row()

    def bind(self, scope, want=True):
        return self.inner.bind(scope, not want)


class _Leaf(Condition):
    def operands(self) -> list[Expr]:
        raise NotImplementedError

    def refs(self):
        return [r for e in self.operands() for r in e.refs()]

    def whole_row(self):
        return any(e.whole_row() for e in self.operands())


@dataclass(frozen=True)
class Compare(_Leaf):
    left: Expr
    op: str
    right: Expr

    def operands(self):
        return [self.left, self.right]

    def bind(self, scope, want=True):
        left, right = self.left.bind(scope), self.right.bind(scope)
        if self.op in ("==", "!="):
            return equal_values(left, right, (self.op == "==") == want)
        return compare_values(left, self.op, right, want)


@dataclass(frozen=True)
class IsEmpty(_Leaf):
    operand: Expr

    def operands(self):
        return [self.operand]

    def bind(self, scope, want=True):
        v = self.operand.bind(scope)
        empty = v.column.isNull()
        filled = v.column.isNotNull()
        if v.kind is Kind.TEXT:
            blank = utrim(v.column) == ""
            return (empty | blank) if want else (filled & ~blank)
        if v.kind is Kind.CELL:
            blank = (v.column["kind"] == "text") & (utrim(v.column["text"]) == "")
            return (empty | blank) if want else (filled & ~blank)
        return empty if want else filled


@dataclass(frozen=True)
class In(_Leaf):
    operand: Expr
    items: tuple[Expr, ...]

    def operands(self):
        return [self.operand, *self.items]

    def bind(self, scope, want=True):
        v = self.operand.bind(scope)
        pairs = [comparable(v, i.bind(scope)) for i in self.items]
        if not pairs:
            return F.lit(not want)
        # One IN per way of comparing; constants of the column's own type stay native.
        groups: dict[bool, tuple[Column, list[Column]]] = {}
        for left, right, native in pairs:
            groups.setdefault(native, (left, []))[1].append(right)
        tests = [left.isin(*rights) for left, rights in groups.values()]
        if want:
            return reduce(lambda a, b: a | b, tests)
        return ~reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


@dataclass(frozen=True)
class Like(_Leaf):
    operand: Expr
    pattern: Expr

    def operands(self):
        return [self.operand, self.pattern]

    def bind(self, scope, want=True):
        text = F.lower(display_or_empty(self.operand.bind(scope)))
        pattern = self.pattern.bind(scope)
        # A backslash is an ordinary character here; Spark would escape with it.
        shape = F.replace(F.lower(display_or_empty(pattern)), F.lit("\\"), F.lit("\\\\"))
        if isinstance(pattern.const if pattern.is_const else None, str):
            hit = text.like(pattern.const.lower().replace("\\", "\\\\"))
        else:
            hit = F.like(text, shape)
        return hit if want else ~hit


@dataclass(frozen=True)
class Between(_Leaf):
    operand: Expr
    low: Expr
    high: Expr

    def operands(self):
        return [self.operand, self.low, self.high]

    def bind(self, scope, want=True):
        v = self.operand.bind(scope)
        above = compare_values(v, ">=", self.low.bind(scope), want)
        below = compare_values(v, "<=", self.high.bind(scope), want)
        return (above & below) if want else (above | below)


# --- value level ------------------------------------------------------------


def comparable(left: Value, right: Value) -> tuple[Column, Column, bool]:
    """Columns whose plain equality is key equality, and whether they are native.

    Native columns keep joins and filters on the stored type: no text is built,
    and bucketing, pushdown and runtime filters keep working.
    """
    left, right = _adapt(left, right), _adapt(right, left)
    if left.kind is right.kind and left.kind in (*_NATIVE, Kind.FLOAT):
        return left.column, right.column, True
    return key(left), key(right), False


def _adapt(v: Value, other: Value) -> Value:
    """Give a constant the other side's type where that changes no outcome."""
    if not v.is_const or v.const is None:
        return v
    const, to = v.const, other.kind
    if to in _NUMBERS and v.kind is Kind.TEXT and re.fullmatch(r"0|-?[1-9][0-9]{0,14}", const.strip()):
        v = Value(F.lit(int(const)).cast("bigint"), Kind.INTEGER, int(const))
        const = v.const
    if to is Kind.FLOAT and v.kind is Kind.INTEGER and abs(const) < 2**53:
        return Value(F.lit(float(const)), Kind.FLOAT, float(const))
    if to is Kind.INTEGER and v.kind is Kind.FLOAT and const.is_integer() and abs(const) < 2**53:
        return Value(F.lit(int(const)).cast("bigint"), Kind.INTEGER, int(const))
    if to is Kind.DATE and v.kind is Kind.TEXT:
        day = _iso(const.strip(), r"[0-9]{4}-[0-9]{2}-[0-9]{2}", date)
        if day is not None:
            return Value(F.lit(day), Kind.DATE, day)
    return v


def _iso(text: str, pattern: str, cls):
    if not re.fullmatch(pattern, text):
        return None
    try:
        return cls.fromisoformat(text)
    except ValueError:
        return None


def equal_values(left: Value, right: Value, want: bool = True) -> Column:
    """Null-safe key equality, or its negation."""
    span = _second_span(left, right) or _second_span(right, left)
    if span is not None:
        c, start, stop = span
        if start is None:
            return F.lit(not want)
        return (c >= start) & (c < stop) if want else (c < start) | (c >= stop) | c.isNull()
    a, b, _ = comparable(left, right)
    same = a.eqNullSafe(b)
    return same if want else ~same


def _moment(v: Value) -> tuple[datetime, bool] | None:
    """Whole-second moment a constant stands for; the flag marks a bare date text."""
    if not v.is_const:
        return None
    if v.kind is Kind.DATETIME:
        return v.const.replace(microsecond=0, tzinfo=None), False
    if v.kind is Kind.DATE:
        return datetime(v.const.year, v.const.month, v.const.day), True
    if v.kind is Kind.TEXT:
        text = v.const.strip()
        stamp = _iso(text, r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", datetime)
        if stamp is not None:
            return stamp, False
        day = _iso(text, r"[0-9]{4}-[0-9]{2}-[0-9]{2}", date)
        if day is not None:
            return datetime(day.year, day.month, day.day), True
    return None


def _ts(moment: datetime) -> Column:
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")


def _second_span(v: Value, const: Value):
    """Range of stored date-times equal to a constant: keys drop fractions."""
    if v.kind is not Kind.DATETIME or v.is_const:
        return None
    moment = _moment(const)
    if moment is None:
        return None
    start, bare = moment
    if bare:  # a bare date text never equals a date-time text
        return v.column, None, None
    return v.column, _ts(start), _ts(start + timedelta(seconds=1))


def compare_values(left: Value, op: str, right: Value, want: bool = True) -> Column:
    """Order comparison: numeric if both sides are numbers, else by key text."""
    native = _native_order(left, op, right)
    if native is None:
        native = _native_order(right, _MIRRORED[op], left)
    if native is not None:
        test, inverse, nullables = native
        if want:
            return test
        for c in nullables:
            inverse = inverse | c.isNull()
        return inverse
    test = _general_order(left, op, right)
    return test if want else ~F.coalesce(test, F.lit(False))


def _native_order(left: Value, op: str, right: Value):
    """``(test, inverse for non-NULL sides, nullable sides)`` on the stored types."""
    if left.kind is Kind.DATETIME and not left.is_const:
        moment = _moment(right)
        if moment is None:
            return None
        start, bare = moment
        c = left.column
        if bare:
            # '2026-01-02 00:00:00' sorts after '2026-01-02': the day starts above it.
            test, inverse = (c >= _ts(start), c < _ts(start)) if op in (">", ">=") else (
                c < _ts(start), c >= _ts(start))
        else:
            edge = _ts(start if op in (">=", "<") else start + timedelta(seconds=1))
            test, inverse = (c >= edge, c < edge) if op in (">", ">=") else (c < edge, c >= edge)
        return test, inverse, [c]
    a, b = _adapt(left, right), _adapt(right, left)
    if a.kind is b.kind and a.kind in (Kind.INTEGER, Kind.DATE):
        sides = [v.column for v in (a, b) if not v.is_const]
        return _OPS[op](a.column, b.column), _OPS[_OPPOSITE[op]](a.column, b.column), sides
    if {a.kind, b.kind} <= set(_NUMBERS):
        x, y = a.column.cast("double"), b.column.cast("double")
        doubles = [v.column for v in (a, b) if v.kind is Kind.FLOAT and not v.is_const]
        if any(v.is_const and v.kind is Kind.FLOAT and v.const != v.const for v in (a, b)):
            return F.lit(False), F.lit(True), []
        test, inverse = _OPS[op](x, y), _OPS[_OPPOSITE[op]](x, y)
        for c in doubles:  # Spark orders NaN last; here it compares false to all
            test, inverse = test & ~F.isnan(c), inverse | F.isnan(c)
        return test, inverse, [v.column for v in (a, b) if not v.is_const]
    return None


_NEVER_NUMERIC = (Kind.BOOL, Kind.DATE, Kind.DATETIME, Kind.NULL)


def _general_order(left: Value, op: str, right: Value) -> Column:
    by_key = _OPS[op](key(left), key(right))
    if left.kind in _NEVER_NUMERIC or right.kind in _NEVER_NUMERIC:
        return by_key
    x, y = num(left), num(right)
    by_number = _OPS[op](x, y) & ~F.isnan(x) & ~F.isnan(y)
    return F.when(x.isNotNull() & y.isNotNull(), by_number).otherwise(by_key)


# --- builders: a bare string is a column on the left, text on the right -----


def eq(left: Any, right: Any) -> Compare:
    return Compare(as_col(left), "==", as_const(right))


def ne(left: Any, right: Any) -> Compare:
    return Compare(as_col(left), "!=", as_const(right))


def gt(left: Any, right: Any) -> Compare:
    return Compare(as_col(left), ">", as_const(right))


def lt(left: Any, right: Any) -> Compare:
    return Compare(as_col(left), "<", as_const(right))


def ge(left: Any, right: Any) -> Compare:
    return Compare(as_col(left), ">=", as_const(right))


def le(left: Any, right: Any) -> Compare:
    return Compare(as_col(left), "<=", as_const(right))


def is_empty(operand: Any) -> IsEmpty:
    return IsEmpty(as_col(operand))


def not_empty(operand: Any) -> Not:
    return Not(is_empty(operand))


def in_(operand: Any, items: list[Any]) -> In:
    return In(as_col(operand), tuple(as_const(i) for i in items))


def not_in(operand: Any, items: list[Any]) -> Not:
    return Not(in_(operand, items))


def like(operand: Any, pattern: Any) -> Like:
    return Like(as_col(operand), as_const(pattern))


def not_like(operand: Any, pattern: Any) -> Not:
    return Not(like(operand, pattern))


def between(operand: Any, low: Any, high: Any) -> Between:
    return Between(as_col(operand), as_const(low), as_const(high))


def not_between(operand: Any, low: Any, high: Any) -> Not:
    return Not(between(operand, low, high))
