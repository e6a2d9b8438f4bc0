"""Generated values: ids, job times and row hashes.

Ids are random: create them in the projection that is written, never in a frame
that is read twice. Times come from one job start, so every row gets the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowferry.errors import ConfigError
from rowferry.functions.text import display_or_empty
from rowferry.types import Kind, Value

# Separator of row-hash parts, and the ULID digits in order.
UNIT_SEPARATOR = "\x1f"
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

# Generator names, as used in templates and assignments.
LABELS = (
    "GUID", "GUID(Text)", "ULID", "Date", "Date(Text)", "DateTime", "DateTime(Text)",
    "DateTimeOffset", "DateTimeOffset(Text)", "SHA256", "SHA512", "MD5",
)


@dataclass(frozen=True)
class JobClock:
    """The start of the job: local time with its offset."""

    start: datetime = field(default_factory=lambda: datetime.now().astimezone())


def guid() -> Column:
    return F.expr("uuid()")


def ulid(clock: JobClock) -> Column:
    """48 bits of milliseconds and 80 random bits as 26 base-32 digits."""
    millis = max(int(clock.start.timestamp() * 1000), 0)

    def random_40_bits() -> Column:
        digits = F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 10)
        return F.lpad(F.conv(digits, 16, 32), 8, "0")

    head = F.lpad(F.conv(F.lit(str(millis)), 10, 32), 10, "0")
    return F.translate(F.concat(head, random_40_bits(), random_40_bits()), BASE32, CROCKFORD)


def row_text(values: list[Value]) -> Column:
    """Hash input: text of every source column, NULL as empty, joined by U+001F."""
    return F.concat_ws(UNIT_SEPARATOR, *[display_or_empty(v) for v in values])


def row_hash(values: list[Value], algorithm: str) -> Column:
    text = row_text(values)
    if algorithm == "MD5":
        return F.md5(text)
    return F.sha2(text, {"SHA256": 256, "SHA512": 512}[algorithm])


def generate(label: str, row: list[Value], clock: JobClock) -> Value:
    """The value named by a generator label, for a row given by its source columns."""
    known = {name.lower(): name for name in LABELS}
    if label.lower() not in known:
        raise ConfigError(f"unknown generator Gen.{label}; known: {', '.join(LABELS)}")
    name = known[label.lower()]
    start = clock.start
    local = start.replace(tzinfo=None)
    if name.startswith("GUID"):
        return Value(guid(), Kind.TEXT)
    if name == "ULID":
        return Value(ulid(clock), Kind.TEXT)
    if name == "Date":
        return Value(F.lit(local.date()), Kind.DATE, local.date())
    if name == "Date(Text)":
        return _text(local.strftime("%Y-%m-%d"))
    if name == "DateTime":
        return Value(F.lit(local.isoformat(" ")).cast("timestamp_ntz"), Kind.DATETIME, local)
    if name == "DateTime(Text)":
        return _text(local.strftime("%Y-%m-%d %H:%M:%S"))
    if name.startswith("DateTimeOffset"):
        return _text(start.isoformat(timespec="milliseconds"))
    return Value(row_hash(row, name), Kind.TEXT)


def _text(s: str) -> Value:
    return Value(F.lit(s), Kind.TEXT, s)
