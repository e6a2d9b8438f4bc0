"""Operands of a job: column references, constants, templates and generators.

An operand knows nothing about a frame until it is bound to a ``Scope``, which
maps aliases to the columns of the frame at hand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime
from string import Formatter
from typing import Any

from pyspark.sql import functions as F

from rowferry.errors import ConfigError
from rowferry.functions.generators import JobClock, generate
from rowferry.functions.text import display_or_empty
from rowferry.types import SPARK_TYPE, Kind, Value


@dataclass
class Scope:
    """What names mean: alias -> column name (lower case) -> value."""

    main: str
    aliases: dict[str, dict[str, Value]]
    source_row: list[Value]
    clock: JobClock = field(default_factory=JobClock)

    def find(self, alias: str | None, column: str) -> Value:
        name = (alias or self.main).lower()
        if name not in self.aliases:
            raise ConfigError(f"alias [{alias}] is neither the main source nor a lookup")
        columns = self.aliases[name]
        if column.lower() not in columns:
            raise ConfigError(
                f"[{alias or self.main}] has no column [{column}] (available: {', '.join(columns)})"
            )
        return columns[column.lower()]


class Expr:
    def refs(self) -> list["Col"]:
        return []

    def whole_row(self) -> bool:
        """True when the value depends on every source column."""
        return False

    def bind(self, scope: Scope) -> Value:
        raise NotImplementedError


@dataclass(frozen=True)
class Col(Expr):
    alias: str | None
    column: str

    def refs(self) -> list["Col"]:
        return [self]

    def bind(self, scope: Scope) -> Value:
        return scope.find(self.alias, self.column)


@dataclass(frozen=True)
class Const(Expr):
    value: Any

    def bind(self, scope: Scope) -> Value:
        v = self.value
        if v is None:
            return Value(F.lit(None).cast("string"), Kind.NULL, None)
        # bool before int: a Python bool is an int.
        for types, kind in (
            (bool, Kind.BOOL), (int, Kind.INTEGER), (float, Kind.FLOAT), (str, Kind.TEXT),
            (datetime, Kind.DATETIME), (date, Kind.DATE),
        ):
            if isinstance(v, types):
                shown = v.isoformat(" ") if kind is Kind.DATETIME else v
                return Value(F.lit(shown).cast(SPARK_TYPE[kind]), kind, v)
        raise ConfigError(f"constant of type {type(v).__name__} is not supported")


@dataclass(frozen=True)
class Gen(Expr):
    label: str

    def whole_row(self) -> bool:
        return self.label.upper() in ("SHA256", "SHA512", "MD5")

    def bind(self, scope: Scope) -> Value:
        return generate(self.label, scope.source_row, scope.clock)


@dataclass(frozen=True)
class Template(Expr):
    parts: tuple[Expr, ...]

    def refs(self) -> list[Col]:
        return [r for p in self.parts for r in p.refs()]

    def whole_row(self) -> bool:
        return any(p.whole_row() for p in self.parts)

    def bind(self, scope: Scope) -> Value:
        return Value(F.concat(*[display_or_empty(p.bind(scope)) for p in self.parts]), Kind.TEXT)


def col(name: str) -> Col:
    """``column``, ``alias.column`` or ``alias.[column with . inside]``."""
    bracketed = re.fullmatch(r"(?:\[?([^\[\]]+?)\]?\.)?\[([^\[\]]+)\]", name.strip())
    if bracketed:
        return Col(bracketed.group(1), bracketed.group(2))
    alias, dot, column = name.strip().partition(".")
    return Col(alias, column) if dot else Col(None, alias)


def lit(value: Any) -> Const:
    return Const(value)


def concat(*parts: Any) -> Template:
    return Template(tuple(as_const(p) for p in parts))


def template(text: str) -> Expr:
    """``"LDAP: {account.name}"``: holes hold a column, ``Gen.X`` or a number; ``{{`` is a brace."""
    parts: list[Expr] = []
    try:
        pieces = list(Formatter().parse(text))
    except ValueError as e:
        raise ConfigError(f"template {text!r}: {e}") from None
    for literal, hole, spec, conversion in pieces:
        if literal:
            parts.append(Const(literal))
        if hole is not None:
            if spec or conversion or not hole.strip():
                raise ConfigError(f"template {text!r}: a hole holds one column, generator or number")
            parts.append(_hole(hole.strip()))
    if not any(not isinstance(p, Const) or not isinstance(p.value, str) for p in parts):
        return Const("".join(p.value for p in parts))
    return Template(tuple(parts))


def _hole(text: str) -> Expr:
    if text.lower().startswith("gen."):
        return Gen(text[4:])
    if re.fullmatch(r"[+-]?[0-9]+", text):
        return Const(int(text))
    if re.fullmatch(r"[+-]?[0-9]*\.[0-9]+", text):
        return Const(float(text))
    return col(text)


def as_col(x: Any) -> Expr:
    """Left operands: a bare string names a column."""
    return x if isinstance(x, Expr) else (col(x) if isinstance(x, str) else Const(x))


def as_const(x: Any) -> Expr:
    """Right operands and assignments: a bare string is text."""
    return x if isinstance(x, Expr) else Const(x)
