"""Time on TIMESTAMP_NTZ columns, independent of the session's time zone.

Offsets are fixed, in seconds east of UTC; there is no daylight saving.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
CALENDAR = {"d": "day", "w": "week", "M": "month", "y": "year"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a UTC wall-clock time."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), col(c)).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(us).cast("timestamp_ntz"))


def parse_unit(text: str) -> tuple[int, str]:
    """``15m`` -> (15, "m"); units s m h d w M y, the number defaults to 1."""
    m = re.fullmatch(r"\s*([0-9]*)\s*([smhdwMy])\s*", text)
    if not m or m[1] and int(m[1]) == 0:
        raise ValueError(f"not a time unit: {text!r}")
    return int(m[1] or 1), m[2]


def parse_duration(text: str) -> int:
    """Whole seconds of ``1.5h``; without a unit the number is seconds."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([smhd]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(float(m[1]) * SECONDS[m[2] or "s"])


def shift(c: Column | str, seconds: int) -> Column:
    return col(c) + F.expr(f"INTERVAL '{seconds}' SECOND") if seconds else col(c)


def add_duration(c: Column | str, text: str) -> Column:
    return shift(c, parse_duration(text))


def round_ts(c: Column | str, unit: str, tz_offset: int = 0) -> Column:
    """Start of the bucket: seconds to hours count from the epoch; days to years are local, of one unit each."""
    n, u = parse_unit(unit)
    if u in "smh":
        us, step = micros(c), n * SECONDS[u] * 1_000_000
        return from_micros(us - F.pmod(us, F.lit(step)))
    return shift(F.date_trunc(CALENDAR[u], shift(c, tz_offset)).cast("timestamp_ntz"), -tz_offset)


def format_ts(c: Column | str, tz_offset: int = 0) -> Column:
    return F.date_format(shift(c, tz_offset), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_datetime(c: Column | str, tz_offset: int = 0) -> Column:
    """Text to time; null where it is none. Digits alone are s, ms, us or ns by size; else date, time, fraction, zone hour."""
    text = F.trim(col(c))
    number = F.when(text.rlike(r"^[0-9]{1,19}$"), text.try_cast("long"))
    by_size = F.when(number < 10**10, number * 1_000_000).when(number < 10**13, number * 1000).when(number >= 10**16, F.floor(number / 1000)).otherwise(number)
    form = r"^(\d{4})\D(\d{1,2})\D(\d{1,2})(?:\D(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\.(\d{3,9}))?\s*(Z|[+-]\d{1,2}(?::?00)?)?)?$"
    part = lambda k: F.regexp_extract(text, form, k)
    whole = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    fraction = F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("long")
    zone = F.when(part(8) == "Z", 0).when(part(8) != "", F.regexp_extract(part(8), r"^([+-]\d{1,2})", 1).try_cast("int") * 3600).otherwise(tz_offset)
    seconds = F.unix_date(day.try_cast("date")).cast("long") * 86400 + whole(4) * 3600 + whole(5) * 60 + whole(6) - zone
    dated = F.when(text.rlike(form), seconds * 1_000_000 + F.coalesce(fraction, F.lit(0)))
    return from_micros(F.coalesce(by_size, dated))
