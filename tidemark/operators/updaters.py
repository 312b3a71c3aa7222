"""Running updates of a value along an object's rows, as window expressions, and periods that begin with a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import from_micros, micros


def running(how: str, value: str, order: list[str], keys: list[str] | None = None) -> Column:
    """assign, acc, max, min, first, diff_first, diff_prev, count or avg of the rows so far; ``keys`` restart it."""
    w = Window.partitionBy("obj", *(keys or [])).orderBy(*order)
    frame, v = w.rowsBetween(Window.unboundedPreceding, 0), F.col(value)
    simple = {"acc": F.sum, "max": F.max, "min": F.min, "count": F.count, "avg": F.avg, "first": F.first}
    if how in simple:
        return simple[how](v).over(frame)
    if how == "assign":
        return F.last(v, ignorenulls=True).over(frame)
    if how == "diff_first":
        return v - F.first(v).over(frame)
    if how == "diff_prev":
        return v - F.lag(v).over(w)
    raise ValueError(f"unknown updater {how!r}")


def carried(df: DataFrame, made: dict[str, str], value: str, order: list[str], block: Column) -> DataFrame:
    """``running`` for several updaters at once (name: updater), without keys, over objects of any length: rows are sorted
    inside blocks, which take over the state of the object's blocks before. ``block`` must not fall as the order rises."""
    df, v, last = df.withColumn("_block", block), F.col(value), F.struct(*order)
    ends = df.groupBy("obj", "_block").agg(
        F.sum(v).alias("s"), F.count(v).alias("n"), F.max(v).alias("hi"), F.min(v).alias("lo"),
        F.min_by(F.struct(value), last).alias("f"), F.max_by(F.struct(value), last).alias("l"), F.max_by(v, F.when(v.isNotNull(), last)).alias("a"),
    )
    over = Window.partitionBy("obj").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    states = {"s": F.sum("s"), "n": F.sum("n"), "hi": F.max("hi"), "lo": F.min("lo"), "f": F.first("f"), "l": F.last("l"), "a": F.last("a", ignorenulls=True)}
    before = ends.select(F.col("obj").alias("_obj"), F.col("_block").alias("_of"), *[c.over(over).alias(f"_{k}") for k, c in states.items()])
    rows = df.join(before, F.col("obj").eqNullSafe(F.col("_obj")) & F.col("_block").eqNullSafe(F.col("_of")))
    w = Window.partitionBy("obj", "_block").orderBy(*order)
    here = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.when(F.sum(v).over(here).isNull(), F.col("_s")).otherwise(F.sum(v).over(here) + F.coalesce("_s", F.lit(0)))
    count = F.count(v).over(here) + F.coalesce("_n", F.lit(0))
    first = F.coalesce(F.col("_f"), F.first(F.struct(value)).over(here)).getField(value)
    back = F.when(F.lag(F.lit(1)).over(w).isNull(), F.col("_l").getField(value)).otherwise(F.lag(v).over(w))
    how = {
        "acc": total, "count": count, "avg": total / count, "max": F.greatest(F.max(v).over(here), "_hi"), "min": F.least(F.min(v).over(here), "_lo"),
        "first": first, "diff_first": v - first, "diff_prev": v - back, "prev": back, "assign": F.coalesce(F.last(v, ignorenulls=True).over(here), "_a"),
    }
    if unknown := set(made.values()) - set(how):
        raise ValueError(f"unknown updaters {sorted(unknown)}")
    kept = [c for c in df.columns if c != "_block"]
    return rows.select(*kept, *[how[h].alias(n) for n, h in made.items()])


def period(seconds: int) -> Column:
    """Number of the fixed period a row lies in, to restart updaters by."""
    return F.floor(micros("ts") / (seconds * 1_000_000))


def periods(df: DataFrame, seconds: int, order: list[str]) -> DataFrame:
    """Rows with ``period``, the number of the object's period, and ``period_start``, the time of the row that began it: the
    first row, and then each that comes more than ``seconds`` after the start. Rows without a time have no period.

    An object's rows stream through one task in order; only the current start is held.
    """
    us = df.withColumn("_us", micros("ts")).filter("_us is not null")
    kind = us.schema.add("period", "long").add("_start", "long")
    at_obj, at_us, step = us.columns.index("obj"), us.columns.index("_us"), seconds * 1_000_000

    def run(batches):
        obj, start, number = None, None, -1
        for b in batches:
            names, times = b.column(at_obj).to_pylist(), b.column(at_us).to_numpy()
            numbers, starts, at = np.zeros(len(times), np.int64), np.zeros(len(times), np.int64), 0
            while at < len(times):
                if number < 0 or names[at] != obj or times[at] > start + step:
                    number = number + 1 if number >= 0 and names[at] == obj else 0
                    obj, start = names[at], int(times[at])
                end = at
                while end < len(times) and names[end] == obj and times[end] <= start + step:
                    end += 1
                numbers[at:end], starts[at:end], at = number, start, end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers), pa.array(starts)], [*b.schema.names, "period", "_start"])

    sorted_ = us.repartition("obj").sortWithinPartitions("obj", *order)
    return sorted_.mapInArrow(run, kind).select(*df.columns, "period", from_micros(F.col("_start")).alias("period_start"))


def over_periods(df: DataFrame, made: dict[str, str], value: str, seconds: int, order: list[str]) -> DataFrame:
    """Updaters (name: acc, avg, count, max or min) that restart with each period."""
    p = periods(df, seconds, order)
    return p.select(*p.columns, *[running(h, value, order, ["period"]).alias(n) for n, h in made.items()])
