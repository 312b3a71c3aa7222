"""Rows and columns of a table by place: numbering, taking, grouping, reversing, chunking, stacking, single cells.

Places are numbered inside blocks of the first ordering column and shifted by the counts of the blocks before, so no task
sorts a whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the first ordering column that are sorted in one task.
BLOCK = 1 << 16


def numbered(df: DataFrame, order: list[str], keys: tuple[str, ...] = (), name: str = "pos", block: Column | None = None) -> DataFrame:
    """Each row's place from 0, in all or by ``keys``; ``block`` must not fall as the order rises."""
    block = F.floor(F.col(order[0]) / BLOCK) if block is None else block
    df = df.withColumn("_block", block)
    counts = df.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_key_{k}")), keys, F.col("_block").eqNullSafe(F.col("_at")))
    return df.withColumn("_own", own).join(shift, same).select(*[c for c in df.columns if c != "_block"], (F.col("_own") + F.col("_shift")).alias(name))


def take(df: DataFrame, places: list[int], order: list[str], block: Column | None = None) -> DataFrame:
    """The rows at the places, in the order and as often as they are listed (``at`` counts the list)."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(places)), "at long, pos long")
    return numbered(df, order, block=block).join(F.broadcast(wanted), "pos").drop("pos")


def group_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows by one column, which becomes ``group``, each with its place in the group; the order of rows is kept."""
    return numbered(df, order, (key,)).select(F.col(key).alias("group"), "pos", *[c for c in df.columns if c != key])


def reverse(df: DataFrame, order: list[str], block: Column | None = None) -> DataFrame:
    """Rows with their places counted from the end."""
    block = F.floor(F.col(order[0]) / BLOCK) if block is None else block
    return numbered(df, [F.desc(c) for c in order], block=-block)


def chunked(df: DataFrame, size: int, order: list[str], keys: tuple[str, ...] = (), block: Column | None = None) -> DataFrame:
    """Rows with the chunk of ``size`` rows they fall into and their place there."""
    at = numbered(df, order, keys, block=block)
    return at.select(*df.columns, F.floor(F.col("pos") / size).alias("chunk"), F.pmod("pos", F.lit(size)).alias("place"))


def runs(df: DataFrame, key: str, order: list[str], block: Column | None = None) -> DataFrame:
    """Runs of rows that follow each other with one key: run, key, rows."""
    at = numbered(df, order, block=block)
    within = numbered(df, order, (key,), "own", block=block).select(*order, F.col("own").alias("_own"))
    named = at.join(within, order).withColumn("_run", F.col("pos") - F.col("_own"))
    out = named.groupBy(key, "_run").agg(F.min("pos").alias("start"), F.count("*").alias("rows"))
    return out.select("start", key, "rows")


def route(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Rows with the worker that a hash of their key deals them to."""
    return df.withColumn("worker", F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long") % workers)


def stack(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames of several objects as one, with the object's name in front."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("obj"), *[c for c in d.columns if c != "obj"]) for n, d in frames.items()])


def append_where(a: DataFrame, b: DataFrame, test: Column | str) -> DataFrame:
    """The rows of a, and those of b that pass a test."""
    return a.unionByName(b.filter(test))


def fields_first(df: DataFrame, fields: list[str] | None, lead: str = "ts") -> DataFrame:
    """The listed columns, the time in front whether listed or not; all columns without a list."""
    if not fields:
        return df
    keep = [c for c in ("obj",) if c in df.columns]
    return df.select(*keep, lead, *[c for c in fields if c not in (lead, *keep)])


# columns ----------------------------------------------------------------------------------------------------------------------


def insert_column(df: DataFrame, at: int, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return df.select(*df.columns[:at], value.alias(name), *df.columns[at:])


def remove_column(df: DataFrame, which: str | int) -> DataFrame:
    name = df.columns[which] if isinstance(which, int) else which
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    return df.drop(name)


def set_column(df: DataFrame, which: str | int, value: Column) -> DataFrame:
    """The column replaced, cast to the type it had."""
    name = df.columns[which] if isinstance(which, int) else which
    return df.select(*[value.cast(df.schema[c].dataType).alias(c) if c == name else F.col(c) for c in df.columns])


# cells and rows ---------------------------------------------------------------------------------------------------------------


def row_at(df: DataFrame, place: int, order: list[str], block: Column | None = None) -> DataFrame:
    return numbered(df, order, block=block).filter(F.col("pos") == place).drop("pos")


def set_cell(df: DataFrame, where: Column, name: str, value) -> DataFrame:
    return set_column(df, name, F.when(where, F.lit(value)).otherwise(F.col(name)))


def push_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """More rows, whose values must have the columns' types."""
    return df.unionByName(df.sparkSession.createDataFrame(rows, df.schema, verifySchema=True))


def previous(df: DataFrame, columns: list[str], order: list[str], block: Column | None = None, name: str = "_previous") -> DataFrame:
    """Each row with a struct of the ``columns`` of the object's row before, null for the first; sorted inside blocks in front
    of which the last row of the blocks before is put, so rows are dealt once and not joined."""
    block = F.floor(F.col(order[0]) / BLOCK) if block is None else block
    rows = df.withColumn("_block", block).withColumn("_carried", F.lit(False))
    ends = rows.groupBy("obj", "_block").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_end"))
    over = Window.partitionBy("obj").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("obj", "_block", F.lit(True).alias("_carried"), F.last("_end").over(over).alias("_before")).filter("_before IS NOT NULL")
    before = before.select("obj", "_block", "_carried", *[F.col("_before").getField(c).alias(c) for c in columns if c != "obj"])
    here = F.lag(F.struct(*columns)).over(Window.partitionBy("obj", "_block").orderBy(F.desc("_carried"), *order))
    return rows.unionByName(before, allowMissingColumns=True).withColumn(name, here).filter(~F.col("_carried")).select(*df.columns, name)
