"""Emptiness, defaults and object patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_empty(df: DataFrame, name: str) -> Column:
    """NULL, NaN and '' alike."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return c.isNull() | (F.length(c) == 0)
    return c.isNull()


def filled(df: DataFrame, name: str) -> Column:
    """The column with every empty value as NULL."""
    return F.when(~is_empty(df, name), F.col(name))


def zero(kind: T.DataType) -> Column:
    return F.lit("").cast(kind) if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(0).cast(kind)


def matches(c: Column | str, pattern: str) -> Column:
    """Object pattern with ``*`` and ``?``; equality or a prefix where that is all it asks, so it reaches the scan."""
    c = F.col(c) if isinstance(c, str) else c
    if not re.search(r"[*?]", pattern):
        return c == pattern if pattern else F.lit(True)
    if re.fullmatch(r"[^*?]*\*", pattern):
        return c.startswith(pattern[:-1])
    return c.like(re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%").replace("?", "_"))


def matches_any(c: Column | str, patterns: str | list[str]) -> Column:
    patterns = [patterns] if isinstance(patterns, str) else patterns
    plain = [p for p in patterns if p and not re.search(r"[*?]", p)]
    tests = [matches(c, p) for p in patterns if p not in plain]
    if plain:
        tests.append((F.col(c) if isinstance(c, str) else c).isin(plain))
    return reduce(lambda a, b: a | b, tests, F.lit(not patterns))
