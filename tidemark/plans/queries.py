"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import add_duration, format_ts, micros, parse_datetime, round_ts
from ..operators import chain, joins, kv, rollup, scan, sets, updaters
from ..streaming.rollup import notices
from . import table_queries
from .series import S, day, one_per_time, series


AGGS = {"price AS first": "first", "price AS high": "max", "price AS low": "min", "price AS total": "sum", "price AS n": "count", "price AS mean": "avg", "kind AS kinds": "uniq_count", "price AS change": "diff_first", "price AS step": "diff_prev", "price AS before": "prev", "price AS close": "latest"}
ROLLUP_SQL = """SELECT obj, {b} AS ts, arg_min(price, (ts, seq)) AS first, max(price) AS high, min(price) AS low, round(sum(price), 6) AS total, count(*) AS n,
 round(avg(price), 6) AS mean, count(DISTINCT kind) AS kinds, round(arg_max(price, (ts, seq)) - arg_min(price, (ts, seq)), 6) AS change,
 round(arg_max(struct_pack(v := step), (ts, seq)).v, 6) AS step, arg_max(struct_pack(v := before), (ts, seq)).v AS before, arg_max(price, (ts, seq)) AS close
FROM (SELECT *, lag(price) OVER w AS before, price - lag(price) OVER w AS step FROM {t} WINDOW w AS (PARTITION BY obj, {b} ORDER BY ts, seq)) GROUP BY 1, 2"""
ASOF = "SELECT l.obj, l.ts, l.seq, l.price, {paid} FROM s l ASOF LEFT JOIN p r ON l.obj = r.obj AND l.ts {op} r.ts"
P = "p AS (SELECT obj, ts, max(paid) AS paid FROM (SELECT obj, ts, price AS paid FROM s WHERE kind = 'purchase') GROUP BY obj, ts)"


def tidy(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("total", "mean", "change", "step") else F.col(c) for c in df.columns])


def _asof(method):
    return lambda spark, d: joins.asof((s := series(spark, d)).select("obj", "ts", "seq", "price"), one_per_time(s), method)


def _exact(fill):
    return lambda spark, d: joins.left_join((s := series(spark, d)).select("obj", "ts", "seq", "price"), one_per_time(s), fill)


def _nation_kv(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    writes = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"), F.col("n_nationkey").cast("long").alias("seq"))
    again = writes.filter("seq % 5 = 0").select("key", F.concat(F.lit("new"), "value").alias("value"), (F.col("seq") + 100).alias("seq"))
    return kv.current(writes.unionByName(again))


def _panel(spark, d):
    days = rollup.rollup(series(spark, d), "1d", {"price AS close": "latest"})
    return joins.align(days, days.agg(F.min("obj").alias("obj")), "backward").select("obj", "ts", "close", "pos")


def _chain(spark, d):
    s = series(spark, d)
    rule = chain.parse_rule("bars: price, changed_if(kind, obj)")
    return chain.project(s, rule, ["open", "kind"], ["ts", "seq"])


def _updaters(spark, d):
    how = ("acc", "max", "min", "first", "diff_first", "diff_prev", "count", "avg")
    order = ["ts", "seq"]
    s = updaters.carried(series(spark, d).withColumn("day", updaters.period(86400)), {h: h for h in how}, "price", order, day())
    return s.select("obj", *order, *[F.round(h, 6).alias(h) for h in how], F.round(updaters.running("acc", "price", order, ["day"]), 6).alias("day_acc"))


def _rounded(spark, d):
    s = series(spark, d)
    return s.select("seq", *[round_ts("ts", u, 8 * 3600).alias(f"by_{u}") for u in ("15m", "2h", "1d", "1w", "1M", "1y")], add_duration("ts", "1.5h").alias("later"), format_ts("ts").alias("shown"), micros("ts").alias("us"))


def _parsed(spark, d):
    s = series(spark, d)
    us = micros("ts")
    return s.select("seq", parse_datetime(us.cast("string")).alias("from_us"), parse_datetime(F.floor(us / 1000).cast("string")).alias("from_ms"), parse_datetime(F.concat(format_ts("ts"), F.lit("+08"))).alias("zoned"))


QUERIES = {
    "scan_range": lambda s, d: scan.scan(series(s, d), start="2024-01-05", end="2024-01-20", columns=["price"]),
    "scan_wildcard": lambda s, d: scan.scan(series(s, d), ["U0000*", "U???1?5"]),
    "list_objects": lambda s, d: scan.list_objects(series(s, d), "U*"),
    "limit_per_object": lambda s, d: scan.scan(series(s, d), desc=True, limit_per_obj=3, offset=1),
    "latest_per_object": lambda s, d: scan.latest(series(s, d), ["ts", "seq"]),
    "chunk_report": lambda s, d: scan.chunk_report(series(s, d), 50, ["ts", "seq"]),
    "rollup_day": lambda s, d: tidy(rollup.rollup(series(s, d), "1d", AGGS)),
    "rollup_hour": lambda s, d: tidy(rollup.rollup(series(s, d), "1h", AGGS)),
    "rollup_drop_late": lambda s, d: tidy(rollup.rollup(series(s, d), "1d", AGGS, late="drop")),
    "rollup_lineitem": lambda s, d: rollup.rollup(s.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("obj"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")), "1M", {"quantity AS volume": "sum", "price AS open": "first", "price AS high": "max", "price AS low": "min", "price AS close": "latest"}),
    "join_asof_backward": _asof("backward"),
    "join_asof_forward": _asof("forward"),
    "join_asof_nearest": _asof("nearest"),
    "join_left": _exact("nan"),
    "join_left_zero": _exact("zero"),
    "panel_align": _panel,
    "chain_project": _chain,
    "running_updaters": _updaters,
    "round_ts": _rounded,
    "parse_datetime": _parsed,
    "kv_current": _nation_kv,
    "delete_range": lambda s, d: sets.without(series(s, d), "U0001*", "2024-01-10", "2024-01-20"),
    "change_notices": lambda s, d: notices(series(s, d), "events"),
}

_R = "round({} , 6) AS {}".format
_W = "OVER (PARTITION BY obj ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
ORACLE_SQL = {
    "scan_range": f"WITH {S} SELECT obj, ts, price FROM s WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'",
    "scan_wildcard": f"WITH {S} SELECT * FROM s WHERE obj LIKE 'U0000%' OR obj LIKE 'U___1_5'",
    "list_objects": f"WITH {S} SELECT DISTINCT obj FROM s",
    "limit_per_object": f"WITH {S} SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY obj ORDER BY ts DESC, seq, price, kind) BETWEEN 2 AND 4",
    "latest_per_object": f"WITH {S} SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY obj ORDER BY ts DESC, seq DESC) = 1",
    "chunk_report": f"WITH {S} SELECT obj, chunk, min(ts) AS start, max(ts) AS \"end\", count(*) AS count FROM (SELECT obj, ts, (row_number() OVER (PARTITION BY obj ORDER BY ts, seq) - 1) // 50 AS chunk FROM s) GROUP BY 1, 2",
    "rollup_day": f"WITH {S} " + ROLLUP_SQL.format(b="date_trunc('day', ts)::TIMESTAMP", t="s"),
    "rollup_hour": f"WITH {S} " + ROLLUP_SQL.format(b="date_trunc('hour', ts)", t="s"),
    "rollup_drop_late": f"WITH {S}, k AS (SELECT obj, ts, seq, price, kind FROM s QUALIFY date_trunc('day', ts) >= coalesce(max(date_trunc('day', ts)) OVER (PARTITION BY obj ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '1970-01-01')) " + ROLLUP_SQL.format(b="date_trunc('day', ts)::TIMESTAMP", t="k"),
    "rollup_lineitem": "SELECT 'P' || l_partkey AS obj, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS volume, arg_min(l_extendedprice, (l_shipdate, l_orderkey * 10 + l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_shipdate, l_orderkey * 10 + l_linenumber)) AS close FROM lineitem GROUP BY 1, 2",
    "join_asof_backward": f"WITH {S}, {P} " + ASOF.format(op=">=", paid="r.paid"),
    "join_asof_forward": f"WITH {S}, {P} " + ASOF.format(op="<=", paid="r.paid"),
    "join_asof_nearest": f"WITH {S}, {P}, b AS ({ASOF.format(op='>=', paid='r.paid, r.ts AS rts')}), f AS ({ASOF.format(op='<=', paid='r.paid, r.ts AS rts')}) SELECT b.obj, b.ts, b.seq, b.price, CASE WHEN b.rts IS NULL OR f.rts - f.ts < b.ts - b.rts THEN f.paid ELSE b.paid END AS paid FROM b JOIN f USING (seq)",
    "join_left": f"WITH {S}, {P} SELECT s.obj, s.ts, s.seq, s.price, p.paid FROM s LEFT JOIN p ON s.obj = p.obj AND s.ts = p.ts",
    "join_left_zero": f"WITH {S}, {P} SELECT s.obj, s.ts, s.seq, s.price, coalesce(p.paid, 0) AS paid FROM s LEFT JOIN p ON s.obj = p.obj AND s.ts = p.ts",
    "panel_align": f"WITH {S}, d AS (SELECT obj, date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(price, (ts, seq)) AS close FROM s GROUP BY 1, 2), m AS (SELECT min(obj) AS base FROM d), g AS (SELECT o.obj, t.ts FROM (SELECT DISTINCT obj FROM d) o, (SELECT DISTINCT ts FROM d, m WHERE obj = base) t) SELECT g.obj, g.ts, d.close, CASE WHEN g.obj = base THEN 0 ELSE 1 END AS pos FROM m, g ASOF LEFT JOIN d ON g.obj = d.obj AND g.ts >= d.ts",
    "chain_project": f"WITH {S} SELECT obj, ts, seq, price AS open, CASE WHEN kind = lag(kind) OVER (PARTITION BY obj ORDER BY ts, seq) THEN obj ELSE kind END AS kind FROM s",
    "running_updaters": f"WITH {S} SELECT obj, ts, seq, {_R(f'sum(price) {_W}', 'acc')}, {_R(f'max(price) {_W}', 'max')}, {_R(f'min(price) {_W}', 'min')}, {_R(f'first(price) {_W}', 'first')}, {_R(f'price - first(price) {_W}', 'diff_first')}, {_R('price - lag(price) OVER (PARTITION BY obj ORDER BY ts, seq)', 'diff_prev')}, count(price) {_W} AS count, {_R(f'avg(price) {_W}', 'avg')}, {_R('sum(price) ' + _W.replace('obj', 'obj, date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)', 1), 'day_acc')} FROM s",
    "round_ts": "SELECT event_id AS seq, time_bucket(INTERVAL 15 MINUTE, ts) AS by_15m, time_bucket(INTERVAL 2 HOUR, ts) AS by_2h, " + ", ".join(f"date_trunc('{w}', ts + INTERVAL 8 HOUR)::TIMESTAMP - INTERVAL 8 HOUR AS by_1{u}" for u, w in (("d", "day"), ("w", "week"), ("M", "month"), ("y", "year"))) + ", ts + INTERVAL 90 MINUTE AS later, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS shown, epoch_us(ts) AS us FROM events",
    "parse_datetime": "SELECT event_id AS seq, ts AS from_us, date_trunc('millisecond', ts) AS from_ms, ts - INTERVAL 8 HOUR AS zoned FROM events",
    "kv_current": "SELECT n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'new' ELSE '' END || n_regionkey AS value FROM nation",
    "delete_range": f"WITH {S} SELECT * FROM s WHERE NOT (obj LIKE 'U0001%' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')",
    "change_notices": f"WITH {S} SELECT 'events' AS \"table\", obj, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS count FROM s GROUP BY obj",
}
QUERIES |= table_queries.QUERIES
ORACLE_SQL |= table_queries.ORACLE_SQL
