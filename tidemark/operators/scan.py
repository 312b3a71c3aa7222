"""Range scans, listings and per-object limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros
from ..functions.values import matches_any
from .rows import chunked


def scan(df: DataFrame, obj: str | list[str] = "", start=None, end=None, columns: list[str] | None = None, desc: bool = False, limit_per_obj: int | None = None, offset: int = 0, start_open: bool = False, end_open: bool = True) -> DataFrame:
    """Rows of matching objects in a time range, with obj and ts always kept, in schema order, limited per object."""
    if obj:
        df = df.filter(matches_any("obj", obj))
    ts, as_ts = F.col("ts"), lambda v: v if isinstance(v, Column) else F.lit(v).cast("timestamp_ntz")
    if start is not None:
        df = df.filter(ts > as_ts(start) if start_open else ts >= as_ts(start))
    if end is not None:
        df = df.filter(ts < as_ts(end) if end_open else ts <= as_ts(end))
    if columns is not None:
        wanted = {"obj", "ts", *(c.lower() for c in columns)}
        shown = [c for c in df.columns if c.lower() in wanted]
    else:
        shown = df.columns
    if limit_per_obj is not None or offset:
        others = [c for c in df.columns if c not in ("obj", "ts")]
        order = [F.desc("ts") if desc else F.asc("ts"), *others]
        n = F.row_number().over(Window.partitionBy("obj").orderBy(*order))
        df = df.withColumn("_n", n)
        df = df.filter(F.col("_n") <= offset + limit_per_obj) if limit_per_obj is not None else df
        df = df.filter(F.col("_n") > offset)
    return df.select(*shown)


def ordered(df: DataFrame, desc: bool = False) -> DataFrame:
    return df.orderBy("obj", F.desc("ts") if desc else F.asc("ts"))


def list_objects(df: DataFrame, pattern: str = "") -> DataFrame:
    return df.filter(matches_any("obj", pattern)).select("obj").distinct()


def latest(df: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each object by ``order``: a partial aggregation, no sort."""
    last = df.groupBy("obj").agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return last.select("r.*")


def prefix(df: DataFrame, column: str, start: str, desc: bool = False, limit: int | None = None) -> DataFrame:
    """Rows whose key begins with ``start``, in the key's order, as many as asked for: a top-k, not a whole sort."""
    got = df.filter(F.col(column).startswith(start)).orderBy(F.desc(column) if desc else F.asc(column))
    return got if limit is None else got.limit(limit)


def point(df: DataFrame, column: str, key) -> DataFrame:
    """The rows of one key."""
    return df.filter(F.col(column) == F.lit(key))


def next_key(df: DataFrame, column: str, at) -> DataFrame:
    """The first row at or after a key."""
    return df.filter(F.col(column) >= F.lit(at)).orderBy(column).limit(1)


def requests(tables: dict[str, DataFrame], pattern: str | list[str] = "", limit_per_obj: int | None = None) -> DataFrame:
    """What a query asks of each table and object: table, obj and limit, one row for each."""
    out = [d.filter(matches_any("obj", pattern)).select("obj").distinct().select(F.lit(n).alias("table"), "obj", F.lit(limit_per_obj).cast("long").alias("limit")) for n, d in tables.items()]
    return reduce(DataFrame.unionByName, out)


def chunk_report(df: DataFrame, size: int, order: list[str], block: Column | None = None) -> DataFrame:
    """obj, chunk, start, end and count of every run of ``size`` rows of an object; rows are sorted inside blocks."""
    block = F.floor(micros(order[0]) / 86_400_000_000) if block is None else block
    at = chunked(df.select("obj", *order), size, order, ("obj",), block)
    return at.groupBy("obj", "chunk").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("count"))


def overlapping(report: DataFrame, start, end) -> DataFrame:
    """The chunks of a report that may hold rows of a time range."""
    as_ts = lambda v: F.lit(v).cast("timestamp_ntz")
    return report.filter((F.col("end") >= as_ts(start)) & (F.col("start") < as_ts(end)))
