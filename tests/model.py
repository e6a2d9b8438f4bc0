"""A tiny pure-Python model of text, keys, comparison and LIKE, used as a test oracle."""

from __future__ import annotations

import math
import re
from datetime import date, datetime
from decimal import Decimal


def display(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        text = format(Decimal(repr(v)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, date):
        return v.isoformat()
    return v


def key(v):
    if v is None:
        return None
    if isinstance(v, str):
        return v.strip().lower() or None
    if isinstance(v, float) and math.isfinite(v) and v % 1 == 0 and abs(v) < 2**63:
        return str(int(v))
    return display(v)


def num(v):
    if isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str):
        t = v.strip()
        if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t, re.ASCII):
            return float(t)
        if re.fullmatch(r"[+-]?(inf|infinity|nan)", t, re.ASCII | re.IGNORECASE):
            return float(t)
    return None


def compare(a, op, b):
    if op == "==":
        return key(a) == key(b)
    if op == "!=":
        return key(a) != key(b)
    x, y = num(a), num(b)
    if x is None or y is None:
        x, y = key(a), key(b)
        if x is None or y is None:
            return False
        x, y = x.encode(), y.encode()
    return {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[op]


def like(value, pattern):
    shape = "".join(
        ".*" if c == "%" else "." if c == "_" else re.escape(c) for c in (pattern or "").lower()
    )
    return re.fullmatch(shape, (display(value) or "").lower(), re.DOTALL) is not None
