"""Appending, replacing and deleting rows of tables, as transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import matches_any


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    if [(f.name.lower(), f.dataType) for f in a.schema] != [(f.name.lower(), f.dataType) for f in b.schema]:
        raise ValueError("schemas differ")
    return a.unionByName(b)


def without(df: DataFrame, obj: str | list[str] = "", start=None, end=None) -> DataFrame:
    """The rows that a deletion by object pattern and time range leaves; no condition at all empties the table."""
    hit: Column = matches_any("obj", obj) if obj else F.lit(True)
    if start is not None:
        hit &= F.col("ts") >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        hit &= F.col("ts") < F.lit(end).cast("timestamp_ntz")
    return df.filter(~F.coalesce(hit, F.lit(False)))
