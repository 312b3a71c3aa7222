"""Casts, arithmetic, comparison and parsing between the thirteen kinds of cells.

Kinds are Spark types: time TIMESTAMP_NTZ, 64-bit decimals DECIMAL(17, scale), unsigned numbers the next wider signed type.
A pair that has no cast gives null, as does a value that doesn't fit; ``strict`` raises instead, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .time import from_micros, micros, parse_datetime

#: Which kinds a kind can become.
CASTS = {
    "timestamp_ntz": ("int", "decimal(20,0)", "float", "double"),
    "int": ("bigint", "double", "timestamp_ntz"),
    "bigint": ("int", "double", "timestamp_ntz"),
    "float": ("timestamp_ntz", "double", "int"),
    "double": ("float", "timestamp_ntz", "decimal(17,3)"),
    "decimal(17,3)": ("double",),
    "string": ("int", "bigint", "float", "double", "decimal(17,3)", "binary", "timestamp_ntz"),
}


def cast(c: Column, source: str, target: str, strict: bool = False) -> Column:
    """``c`` of kind ``source`` as ``target``. Whole numbers are microseconds and fractions seconds where they become times,
    times become microseconds as whole numbers and milliseconds as fractions."""
    if source == target:
        return c
    if target not in CASTS.get(source, ()):
        if strict:
            raise ValueError(f"{source} can't become {target}")
        return F.lit(None).cast(target)
    if source == "timestamp_ntz":
        us = micros(c)
        out = us / 1000 if target in ("float", "double") else us
        return _fit(out, target, strict)
    if target == "timestamp_ntz":
        if source == "string":
            return parse_datetime(c)
        return from_micros(c.cast("long") if source in ("int", "bigint") else (c.cast("double") * 1_000_000).cast("long"))
    if source == "string" and target != "binary":
        c = F.trim(c)
    return _fit(c, target, strict)


def _fit(c: Column, target: str, strict: bool) -> Column:
    return c.cast(target) if strict else c.try_cast(target)


def arithmetic(a: Column, b: Column, sign: str, kind: str, other: str | None = None) -> Column:
    """``a`` of a kind with ``b`` cast to it; where b can't be cast, a stays. Text is joined by ``+``; whole numbers divide
    towards zero and by zero give null, decimals keep the left scale."""
    right = b if other in (None, kind) else cast(b, other, kind)
    if kind == "string":
        out = F.concat(a, right) if sign == "+" else a
    else:
        if sign == "/":
            q = F.try_divide(a, right)
            out = F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)) if kind in ("int", "bigint") else q
        else:
            out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign](a, right)
        out = out.try_cast(kind)
    return F.when(right.isNull() & (F.lit(sign) != "/"), a).otherwise(out)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; empty values come first and equal each other, NaN is the greatest number."""
    return F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)


def cell_hash(*columns: Column) -> Column:
    """Equal cells have equal hashes, whatever their row."""
    return F.xxhash64(*columns)


def parsed(c: Column, kind: T.DataType | str, empty: Column | None = None) -> Column:
    """A typed value from text; blank or unreadable text gives ``empty``, null by default."""
    name = kind if isinstance(kind, str) else kind.simpleString()
    text = F.trim(c)
    if name in ("timestamp_ntz", "timestamp"):
        out = parse_datetime(text)
    elif name == "boolean":
        out = F.when(F.lower(text).isin("true", "1", "t", "yes"), True).when(F.lower(text).isin("false", "0", "f", "no"), False)
    else:
        out = F.when(text != "", text).try_cast(name) if name not in ("string", "binary") else c.cast(name)
    return out if empty is None else F.coalesce(out, empty)


def decimal64(c: Column, scale: int = 6) -> Column:
    """A number with up to 17 digits, ``scale`` of them after the point (15 at most), halves rounded away from zero."""
    if not 0 <= scale <= 15:
        raise ValueError("a scale is 0 to 15")
    return F.round(c.try_cast(f"decimal(38,{min(20, scale + 5)})"), scale).try_cast(f"decimal(17,{scale})")


def spelled(c: Column, scale: int) -> Column:
    """A decimal as text with all digits of its scale."""
    return c.cast(f"decimal(17,{scale})").cast("string")


def now() -> Column:
    """The current time, UTC wall clock."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
