"""Rollup of raw rows into time buckets, one aggregate to a column.

Aggregates: latest (default), first, min, max, sum, count, avg, uniq_count, diff_first, diff_prev, prev. Rows of a bucket are
ordered by (ts, seq). Late rows, those whose bucket lies before one that already came in, are dropped or merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import round_ts
from ..functions.values import filled

#: Rows of one object by arrival that a window sorts in one task.
BLOCK = 1 << 16


def drop_late(df: DataFrame, bucket: str = "bucket", seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """Rows whose bucket is at least the greatest that came before; a row without an arrival number came last, one without a
    bucket goes. The running maximum is taken inside blocks of arrival numbers and carried over from the blocks before, so an
    object with very many rows spreads over tasks."""
    blocked = df.filter(F.col(bucket).isNotNull()).withColumn("_block", F.coalesce(F.floor(F.col(seq) / block), F.lit((1 << 63) - 1)))
    tops = blocked.groupBy("obj", "_block").agg(F.max(bucket).alias("_top"))
    before = Window.partitionBy("obj").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(F.col("obj").alias("_obj"), F.col("_block").alias("_of"), F.max("_top").over(before).alias("_carried"))
    inside = Window.partitionBy("obj", "_block").orderBy(F.asc_nulls_last(seq)).rowsBetween(Window.unboundedPreceding, -1)
    known = blocked.withColumn("_top", F.max(bucket).over(inside)).join(carried, F.col("obj").eqNullSafe(F.col("_obj")) & (F.col("_block") == F.col("_of")))
    limit = F.greatest("_top", "_carried")  # skips nulls
    return known.filter(limit.isNull() | (F.col(bucket) >= limit)).select(*df.columns)


def aggregate(df: DataFrame, name: str, how: str, order: Column) -> Column:
    value, c = filled(df, name), F.col(name)
    simple = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "uniq_count": F.count_distinct}
    if how in simple:
        return simple[how](value)
    if how == "count":
        return F.count(F.lit(1))
    if how == "first":
        return F.min_by(c, order)
    if how == "diff_first":
        return F.max_by(c, order) - F.min_by(c, order)
    if how == "diff_prev":
        return F.max_by(F.col(f"_step_{name}"), order)
    if how == "prev":
        return F.max_by(F.col(f"_prev_{name}"), order)
    if how == "latest":
        return F.max_by(c, F.when(value.isNotNull(), order))
    raise ValueError(f"unknown aggregate {how!r}")


def rollup(df: DataFrame, unit: str, aggs: dict[str, str], late: str = "merge", seq: str = "seq", tz_offset: int = 0) -> DataFrame:
    """obj, ts (start of the bucket) and one column per entry of ``aggs``, named ``column`` or ``column AS name``."""
    made = {(k.split(" AS ")[-1].strip()): (k.split(" AS ")[0].strip(), how) for k, how in aggs.items()}
    df = df.withColumn("bucket", round_ts("ts", unit, tz_offset))
    if late == "drop":
        df = drop_late(df, "bucket", seq)
    for c in sorted({c for c, how in made.values() if how in ("diff_prev", "prev")}):
        before = F.lag(c).over(Window.partitionBy("obj", "bucket").orderBy("ts", seq))
        df = df.withColumn(f"_prev_{c}", before).withColumn(f"_step_{c}", F.col(c) - F.col(f"_prev_{c}"))
    order = F.struct("ts", seq)
    return df.groupBy("obj", "bucket").agg(*[aggregate(df, c, how, order).alias(name) for name, (c, how) in made.items()]).withColumnRenamed("bucket", "ts")
