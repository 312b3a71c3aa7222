"""Key-value tables: the last write of a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import matches_any


def current(writes: DataFrame) -> DataFrame:
    """key and value of the last write (by seq) of each key; a null value is a deletion."""
    last = writes.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("r"))
    return last.select("key", "r.value").filter("value is not null")


def get(writes: DataFrame, keys: str | list[str] = "") -> DataFrame:
    return current(writes.filter(matches_any("key", keys)))


def delete(table: DataFrame, keys: str | list[str] = "") -> DataFrame:
    """The rows whose key does not match; no pattern empties the table."""
    return table.filter(~matches_any("key", keys)) if keys else table.limit(0)


def unexpired(table: DataFrame, now, column: str = "expire_at") -> DataFrame:
    return table.filter(F.col(column).isNull() | (F.col(column) > F.lit(now)))
