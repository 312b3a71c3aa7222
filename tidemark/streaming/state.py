"""Exact streams: each object's open bucket, or its last row, is kept between micro-batches.

State is small (one bucket's folds of an object), lives in the query's checkpoint and survives restarts. Objects are dealt by
hash into shards, and a micro-batch calls Python once for each shard it touches, not for each object; a shard's state is one
map, of which only touched objects are unpacked. A micro-batch's rows of one object are folded in the order of time and
arrival, in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.time import from_micros, micros, round_ts
from ..operators.chain import Rule

#: Shards of a stream. A checkpoint goes on with the number it began with; a shard should have some thousand objects at most.
SHARDS = 1 << 10
#: Types whose nulls pandas would turn, with all other values, into floats; where rows without a number sort.
WHOLE = ("tinyint", "smallint", "int", "bigint")
LAST = (1 << 63) - 1


def _empty(v) -> bool:
    return v is None or v is pd.NaT or v == "" or isinstance(v, float) and v != v


class Fold:
    """What every aggregate needs of a bucket's values of one column."""

    def __init__(self):
        self.n, self.filled, self.total, self.low, self.high, self.latest, self.seen = 0, 0, None, None, None, None, set()
        self.first = self.previous = self.last = None

    def add(self, v) -> None:
        v = None if isinstance(v, float) and v != v or v is pd.NaT else v
        self.first, self.previous, self.last = (v if not self.n else self.first), self.last, v
        self.n += 1
        if not _empty(v):
            self.filled, self.latest = self.filled + 1, v
            self.low, self.high = (v, v) if self.low is None else (min(self.low, v), max(self.high, v))
            if not isinstance(v, str | bytes):
                self.total = v if self.total is None else self.total + v
            self.seen.add(v)

    def get(self, how: str):
        if how in ("count", "uniq_count"):
            return self.n if how == "count" else len(self.seen)
        if how == "avg":
            return self.total / self.filled if self.filled else None
        if how in ("diff_first", "diff_prev"):
            before = self.first if how == "diff_first" else self.previous
            return None if self.last is None or before is None else self.last - before
        return {"first": self.first, "min": self.low, "max": self.high, "sum": self.total, "latest": self.latest, "prev": self.previous}[how]


def _values(frame: pd.DataFrame, c: str) -> list:
    got = frame[c].tolist()
    if f"{c}_null" in frame and frame[f"{c}_null"].any():
        got = [None if no else v for v, no in zip(got, frame[f"{c}_null"], strict=True)]
    return got


def _by_shard(stream: DataFrame, sent: list[Column], fold: Callable, made: dict[str, str], seq: str, shards: int) -> DataFrame:
    """``fold(rows, held)`` of each shard's rows (obj and the values of ``sent``) by time and arrival; it yields rows of
    ``made`` (names and types) and changes ``held``, each object's state."""
    rows = stream.select(F.col("obj").alias("_obj"), micros("ts").alias("_us"), F.col(seq).alias("_seq"), *[c.alias(f"_v{k}") for k, c in enumerate(sent)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    values = [f"_v{k}" for k in range(len(sent))]
    last = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LAST)).alias(c) if kinds[c] in WHOLE else F.col(c)
    zero = lambda c: F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c)
    plain = [x for c in values for x in ((zero(c), F.col(c).isNull().alias(f"{c}_null")) if kinds[c] in WHOLE else (F.col(c),))]
    rows = rows.select(F.pmod(F.xxhash64("_obj"), F.lit(shards)).alias("_shard"), "_obj", last("_us"), last("_seq"), *plain)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        got = pd.concat(list(frames)).sort_values(["_us", "_seq"], kind="stable")
        objects = [None if _empty(o) and o != "" else o for o in got["_obj"].tolist()]
        out = list(fold(zip(objects, *[_values(got, c) for c in values], strict=True), held))
        state.update((pickle.dumps(held),))
        columns = zip(*out, strict=True) if out else [()] * len(made)
        yield pd.DataFrame({n: pd.Series(list(v), dtype="float64" if t in ("float", "double") else object if t in WHOLE or not out else None) for (n, t), v in zip(made.items(), columns, strict=True)})

    shown = ", ".join(f"`{n}` {t}" for n, t in made.items())
    return rows.groupBy("_shard").applyInPandasWithState(run, shown, "held binary", "append", GroupStateTimeout.NoTimeout)


def exact_rollup(stream: DataFrame, unit: str, aggs: dict[str, str], seq: str = "seq", tz_offset: int = 0, shards: int = SHARDS) -> DataFrame:
    """obj, ts and the aggregates (as in the batch rollup) of every bucket that a micro-batch touched; the last row of a
    bucket that a query gave holds. Rows before an object's open bucket are late and dropped."""
    made = {k.split(" AS ")[-1].strip(): (k.split(" AS ")[0].strip(), how) for k, how in aggs.items()}
    sources = sorted({c for c, _ in made.values()})
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    kind_of = {n: "bigint" if h in ("count", "uniq_count") else "double" if h == "avg" else kinds[c] for n, (c, h) in made.items()}

    def fold(rows: Iterator[tuple], held: dict) -> Iterator[tuple]:
        def given(obj, bucket, folds):
            return (obj, bucket, *(folds[c].get(h) for c, h in made.values()))

        seen: dict = {}
        for obj, at, *values in rows:
            if obj not in seen and obj in held:
                seen[obj] = pickle.loads(held[obj])
            bucket, folds = seen.get(obj, (None, None))
            if folds is not None and bucket is not None and at is not None and at < bucket:
                continue
            if folds is None or at is None or at != bucket:  # rows without a time are buckets of their own
                if folds is not None:
                    yield given(obj, bucket, folds)
                folds = {c: Fold() for c in sources}
                seen[obj] = at, folds
            for f, v in zip(folds.values(), values, strict=True):
                f.add(v)
        for obj, (bucket, folds) in seen.items():
            yield given(obj, bucket, folds)
            held[obj] = pickle.dumps((bucket, folds))

    sent = [micros(round_ts("ts", unit, tz_offset)), *map(F.col, sources)]
    got = _by_shard(stream, sent, fold, {"obj": "string", "_ts": "bigint"} | kind_of, seq, shards)
    return got.select("obj", from_micros(F.col("_ts")).alias("ts"), *made)


def exact_chain(stream: DataFrame, rule: Rule, columns: list[str], seq: str = "seq", shards: int = SHARDS) -> DataFrame:
    """obj, ts, seq and the target's columns of each row; ``changed_if`` compares with the object's row before, also where
    that came in an earlier micro-batch."""
    names = {c.lower(): c for c in stream.columns}
    items = [(names[i.field.lower()], names[i.other.lower()] if i.other else None) for i in rule.items]
    sources = sorted({f for i in items for f in i if f})
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def fold(rows: Iterator[tuple], held: dict) -> Iterator[tuple]:
        seen: dict = {}
        for obj, us, number, *values in rows:
            r = {c: None if not isinstance(v, str | bytes) and pd.isna(v) else v for c, v in zip(sources, values, strict=True)}
            last = seen[obj] if obj in seen else pickle.loads(held[obj]) if obj in held else None
            yield (obj, us, number, *(r[f] if o is None or last is None or last[f] != r[f] else r[o] for f, o in items))
            seen[obj] = r
        held.update((obj, pickle.dumps(r)) for obj, r in seen.items())

    sent = [micros("ts"), F.col(seq), *map(F.col, sources)]
    shown = {"obj": "string", "_us": "bigint", "_seq": "bigint"} | {c: kinds[f] for c, (f, _) in zip(columns, items, strict=True)}
    got = _by_shard(stream, sent, fold, shown, seq, shards)
    return got.select("obj", from_micros(F.col("_us")).alias("ts"), F.col("_seq").alias(seq), *columns)
