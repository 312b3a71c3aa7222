"""As-of and exact joins on (obj, ts), folds over tables and panel alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros
from ..functions.values import zero

METHODS = ("backward", "forward", "nearest", "nan", "zero")
#: Seconds of one object that are sorted in one task.
BLOCK_S = 86400


def _renamed(left: DataFrame, right: DataFrame, suffix: str) -> DataFrame:
    clash = set(left.columns) - {"obj", "ts"}
    return right.select("obj", "ts", *[F.col(c).alias(f"{c}{suffix}" if c in clash else c) for c in right.columns if c not in ("obj", "ts")])


def asof(left: DataFrame, right: DataFrame, method: str = "backward", suffix: str = "_right", tie: str | None = None, block_s: int = BLOCK_S) -> DataFrame:
    """Every left row with the right row of its object last at or before (first at or after, nearest) its time.

    Of right rows of one time, ``tie`` decides: backward takes the greatest, forward the smallest; nearest prefers the
    earlier of two as far away. A left row without an object or a time has no partner and stays.

    Both sides are laid together once and sorted inside blocks of time; a block takes over the last right row of the blocks
    before it (the first of those after), so an object with very many rows spreads over tasks.
    """
    right = _renamed(left, right, suffix)
    extra = [c for c in right.columns if c not in ("obj", "ts")]
    row = left.select(F.struct(*left.columns)).schema[0].dataType
    rows = right.filter("obj is not null and ts is not null").select("obj", "ts", F.lit(None).cast(row).alias("_row"), F.struct("ts", *extra).alias("_right"), F.lit(0).alias("_left"), (F.col(tie) if tie else F.lit(0)).cast("double").alias("_tie"))
    own = left.select("obj", "ts", F.struct(*left.columns).alias("_row"), F.lit(None).cast(rows.schema["_right"].dataType).alias("_right"), F.lit(1).alias("_left"), F.lit(0.0).alias("_tie"))
    both = own.unionByName(rows).withColumn("_us", micros("ts")).withColumn("_block", F.floor(F.col("_us") / (block_s * 1_000_000)))
    key, back, ahead = F.when(F.col("_left") == 0, F.struct("_us", "_tie")), method in ("backward", "nearest"), method in ("forward", "nearest")
    ends = both.filter("_us is not null and obj is not null").groupBy("obj", "_block").agg(F.max_by("_right", key).alias("_last"), F.min_by("_right", key).alias("_first"))
    before = Window.partitionBy("obj").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("obj").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("obj").alias("_obj"), F.col("_block").alias("_of"), *([F.last("_last", True).over(before).alias("_before")] if back else []), *([F.last("_first", True).over(after).alias("_after")] if ahead else []))
    inside = Window.partitionBy("obj", "_block")
    if back:
        both = both.withColumn("_back", F.last("_right", True).over(inside.orderBy("_us", "_left", "_tie").rowsBetween(Window.unboundedPreceding, 0)))
    if ahead:
        both = both.withColumn("_ahead", F.last("_right", True).over(inside.orderBy(F.desc("_us"), "_left", F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)))
    out = both.filter("_left = 1").join(carried, F.col("obj").eqNullSafe(F.col("_obj")) & F.col("_block").eqNullSafe(F.col("_of")), "left")
    out = out.withColumn("_back", F.coalesce("_back", "_before")) if back else out
    out = out.withColumn("_ahead", F.coalesce("_ahead", "_after")) if ahead else out
    if method == "nearest":
        near = F.when(F.col("_back").isNull() | (micros("_ahead.ts") - F.col("_us") < F.col("_us") - micros("_back.ts")), F.col("_ahead")).otherwise(F.col("_back"))
    else:
        near = F.col("_back" if back else "_ahead")
    found = out.withColumn("_found", F.when(F.col("obj").isNotNull() & F.col("ts").isNotNull(), near))
    return found.select("_row.*", *[F.col("_found").getField(c).alias(c) for c in extra])


def left_join(left: DataFrame, right: DataFrame, fill: str = "nan", suffix: str = "_right") -> DataFrame:
    """Exact left join; ``zero`` fills the right columns of rows without a partner, and their nulls."""
    right = _renamed(left, right, suffix)
    out = left.join(right, ["obj", "ts"], "left")
    if fill == "zero":
        extra = {f.name: f.dataType for f in right.schema if f.name not in ("obj", "ts")}
        out = out.select(*[F.coalesce(c, zero(extra[c])).alias(c) if c in extra else c for c in out.columns])
    return out


def join(left: DataFrame, right: DataFrame, method: str = "nan", suffix: str = "_right", tie: str | None = None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"join method {method!r} is none of {METHODS}")
    return left_join(left, right, method, suffix) if method in ("nan", "zero") else asof(left, right, method, suffix, tie)


def load(tables: dict[str, DataFrame], methods: str | dict[str, str] = "nan", start=None, end=None, hook=None) -> DataFrame:
    """Join tables left to right on (obj, ts), each by its method (``*`` is the default); the window holds for the first."""
    how = {"*": methods} if isinstance(methods, str) else methods
    frames = [(n, hook(n, d) if hook else d) for n, d in tables.items()]
    base = frames[0][1]
    for bound, test in ((start, base["ts"] >= F.lit(start).cast("timestamp_ntz")), (end, base["ts"] < F.lit(end).cast("timestamp_ntz"))):
        base = base.filter(test) if bound is not None else base
    return reduce(lambda a, nd: join(a, nd[1], how.get(nd[0], how.get("*", "nan")), f"_{nd[0]}"), frames[1:], base)


def align(df: DataFrame, base: str | DataFrame, method: str = "nan", tie: str | None = None, parts: int = 32) -> DataFrame:
    """Every object at the times of the base object (a name, or one row with ``obj``); ``pos`` orders the panel, base first,
    then objects by name.

    The grid is the result itself: one row for each object and base time. Times are dealt into ``parts`` that every object
    asks for, so the grid is made by an ordinary join and nothing is held in one place.
    """
    base = df.sparkSession.createDataFrame([(base,)], "obj string") if isinstance(base, str) else base.select("obj")
    times = df.join(F.broadcast(base), "obj", "left_semi").select("ts").distinct().withColumn("_part", F.pmod(F.xxhash64("ts"), F.lit(parts)))  # base is one row
    objs = df.select("obj").distinct().withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    out = join(objs.join(times, "_part").select("obj", "ts"), df, method, tie=tie)
    first = base.select(F.col("obj").alias("_obj"), F.lit(0).alias("_pos"))
    return out.join(F.broadcast(first), F.col("obj") == F.col("_obj"), "left").select(*out.columns, F.coalesce("_pos", F.lit(1)).alias("pos"))
