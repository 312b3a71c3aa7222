"""Streaming rollup, chains, change notices and subscriptions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import SECONDS, parse_unit
from ..operators.rollup import aggregate


def stream_rollup(df: DataFrame, unit: str, aggs: dict[str, str], lateness: str = "0 seconds", seq: str = "seq") -> DataFrame:
    """The batch rollup over a stream: event-time windows of a fixed width; later rows than the watermark are dropped.

    Needs ts as TIMESTAMP. Aggregates that need every value of a bucket (uniq_count) or the row before (diff_prev, prev) are
    those of ``state.exact_rollup``.
    """
    if odd := sorted({h for h in aggs.values() if h in ("uniq_count", "diff_prev", "prev")}):
        raise ValueError(f"{odd} need exact_rollup")
    n, u = parse_unit(unit)
    if u not in SECONDS:
        raise ValueError("streams roll up by seconds to days")
    order = F.struct("ts", seq)
    made = {k.split(" AS ")[-1].strip(): (k.split(" AS ")[0].strip(), how) for k, how in aggs.items()}
    marked = df.withWatermark("ts", lateness)
    columns = [aggregate(df, c, how, order).alias(name) for name, (c, how) in made.items()]
    return marked.groupBy("obj", F.window("ts", f"{n * SECONDS[u]} seconds").alias("w")).agg(*columns).select("obj", F.col("w.start").alias("ts"), *made)


def notices(df: DataFrame, table: str) -> DataFrame:
    """One notice per object of a batch: table, obj, first and last time, rows."""
    return df.groupBy("obj").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("count")).select(F.lit(table).alias("table"), "obj", "min_ts", "max_ts", "count")


def fan_out(stream: DataFrame, targets: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[str, DataFrame, int], None], checkpoint: str, **trigger):
    """Start a query that gives each micro-batch, projected for every target, to ``write(target, rows, batch_id)``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        for name, project in targets.items():
            write(name, project(batch), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sliding(df: DataFrame, width: str, step: str, aggs: dict[str, F.Column], lateness: str = "0 seconds") -> DataFrame:
    """obj, start, end and aggregates of windows that overlap; ts as TIMESTAMP; rows later than the watermark are dropped."""
    marked = df.withWatermark("ts", lateness) if df.isStreaming else df
    return _named(marked.groupBy("obj", F.window("ts", width, step).alias("w")), aggs)


def sessions(df: DataFrame, gap: str, aggs: dict[str, F.Column], lateness: str = "0 seconds") -> DataFrame:
    """obj, start, end and aggregates of sessions, which end once no row came for ``gap``."""
    marked = df.withWatermark("ts", lateness) if df.isStreaming else df
    return _named(marked.groupBy("obj", F.session_window("ts", gap).alias("w")), aggs)


def _named(grouped, aggs: dict[str, F.Column]) -> DataFrame:
    return grouped.agg(*[c.alias(n) for n, c in aggs.items()]).select("obj", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


def stop(query, timeout: int = 60) -> None:
    """Let a query finish what has arrived, commit it and end."""
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(timeout)


class Feed:
    """Messages for one listener; what doesn't fit into the queue is dropped and counted."""

    def __init__(self, size: int = 128):
        self.queue, self.size, self.dropped = deque(), size, 0

    def offer(self, message) -> bool:
        if len(self.queue) >= self.size:
            self.dropped += 1
            return False
        self.queue.append(message)
        return True

    def take(self) -> list:
        out = list(self.queue)
        self.queue.clear()
        return out


@dataclass(frozen=True)
class Subscription:
    table: str
    obj: str
    wanted: bool = True


def fit(pattern: str, name: str) -> int | None:
    """How closely a pattern fits: exact names beat prefixes, longer prefixes shorter ones; None if it doesn't."""
    if pattern.endswith("*"):
        return len(pattern) - 1 if name.startswith(pattern[:-1]) else None
    return 1 << 20 if pattern == name else None


def subscribed(rules: list[Subscription], table: str, obj: str) -> bool:
    """The rule that fits best decides, the table before the object, a later rule before an earlier one."""
    best = max((((a, b, k), r.wanted) for k, r in enumerate(rules) if (a := fit(r.table, table)) is not None and (b := fit(r.obj, obj)) is not None), default=(None, False))
    return best[1]


def wanted(notices: DataFrame, rules: list[Subscription]) -> DataFrame:
    """The notices (table, obj) whose best rule asks for them; rules are a short list, so each notice is tested in place."""

    def closeness(pattern: str, name: str) -> F.Column:
        if pattern.endswith("*"):
            return F.when(F.col(name).startswith(pattern[:-1]), F.lit(len(pattern) - 1))
        return F.when(F.col(name) == pattern, F.lit(1 << 20))

    ranks = [F.when((a := closeness(r.table, "table")).isNotNull() & (b := closeness(r.obj, "obj")).isNotNull(), F.struct(a.alias("a"), b.alias("b"), F.lit(k).alias("k"), F.lit(r.wanted).alias("wanted"))) for k, r in enumerate(rules)]
    best = F.array_max(F.array_compact(F.array(*ranks)))
    return notices.filter(F.coalesce(best["wanted"], F.lit(False)))
