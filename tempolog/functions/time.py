"""Times: nanoseconds since the epoch, in and out."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LogError

NANOS = 1_000_000_000
#: From 2000-01-01 on a time is taken for a wall clock's, else for one that counts from a machine's start.
WALL_CLOCK = 946_684_800 * NANOS
_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d\d:\d\d)")


def parse_time(text: str) -> int:
    """Nanoseconds as a number, or RFC 3339; before the epoch is an error."""
    if text.isdigit():
        value = int(text)
    elif m := _RFC3339.fullmatch(text):
        zone = "+00:00" if m[4] in "Zz" else m[4]
        at = datetime.fromisoformat(f"{m[1]}T{m[2]}{zone}").astimezone(timezone.utc)
        value = round((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * NANOS + int((m[3] or "0").ljust(9, "0"))
    else:
        raise LogError(f"not a time: {text}")
    if not 0 <= value < 1 << 64:
        raise LogError(f"time out of range: {text}")
    return value


def parse_time_column(text: Column) -> Column:
    """The same on a column; null for what is no time."""
    fraction = F.rpad(F.coalesce(F.nullif(F.regexp_extract(text, r"\.(\d{1,9})", 1), F.lit("")), F.lit("0")), 9, "0").cast("bigint")
    whole = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, r"\.\d+", "")))
    return F.coalesce(F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")), F.when(whole >= 0, whole * NANOS + fraction))


def nanos_of(ts: Column) -> Column:
    """Of a TIMESTAMP_NTZ, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts) * 1000


def rfc3339(nanos: Column) -> Column:
    """Always nine decimals: then the order of texts is the order of times."""
    base = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    seconds = ((nanos - F.pmod(nanos, F.lit(NANOS))) / F.lit(NANOS)).cast("bigint")
    at = F.timestamp_add("SECOND", seconds, base)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(nanos, F.lit(NANOS)).cast("string"), 9, "0"), F.lit("Z"))


def decimal_seconds(nanos: Column) -> Column:
    whole = ((nanos - F.pmod(nanos, F.lit(NANOS))) / F.lit(NANOS)).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(F.pmod(nanos, F.lit(NANOS)).cast("string"), 9, "0"))


def shown(nanos: Column, style: str = "auto", first: int | None = None, machine: bool = False) -> Column:
    """``auto``: for people by the first value shown, for machines always RFC 3339."""
    if style == "auto":
        style = "rfc3339" if machine or (first or 0) >= WALL_CLOCK else "seconds"
    styles = {"rfc3339": rfc3339, "seconds": decimal_seconds, "nanoseconds": lambda c: c.cast("string")}
    if style not in styles:
        raise LogError(f"unknown time format {style}")
    return styles[style](nanos)


def from_sec_nsec(sec: Column, nsec: Column) -> Column:
    return sec.cast("bigint") * NANOS + nsec.cast("bigint")


def _trimmed(value: Column, unit: int, digits: int) -> Column:
    """``value / unit`` without trailing zeros."""
    rest = F.pmod(value, F.lit(unit))
    whole = ((value - rest) / F.lit(unit)).cast("bigint").cast("string")
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), F.rtrim(F.lpad(rest.cast("string"), digits, "0"), F.lit("0"))))


def duration(nanos: Column) -> Column:
    """``12ns``, ``1.5µs``, ``3ms``, ``2m3.25s``, ``1h0m0s``, with a sign."""
    n = F.abs(nanos)
    seconds = (n - F.pmod(n, F.lit(NANOS))) / F.lit(NANOS)
    hours, minutes = F.floor(seconds / 3600).cast("bigint"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("bigint")
    tail = F.concat(_trimmed(F.pmod(n, F.lit(60 * NANOS)), NANOS, 9), F.lit("s"))
    text = (
        F.when(n < 1_000, F.concat(n.cast("string"), F.lit("ns"))).when(n < 1_000_000, F.concat(_trimmed(n, 1_000, 3), F.lit("µs")))
        .when(n < NANOS, F.concat(_trimmed(n, 1_000_000, 6), F.lit("ms")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), minutes.cast("string"), F.lit("m"), tail))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"), tail)).otherwise(tail)
    )
    return F.concat(F.when(nanos < 0, F.lit("-")).otherwise(F.lit("")), text)
