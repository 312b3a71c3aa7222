"""Registered queries of rows, cells, catalog, formats, updaters and streams, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, values
from ..operators import chain, joins, kv, rows, scan, sets, updaters
from ..sources import files, frames
from ..streaming import rollup as streaming
from ..streaming import state
from .catalog import Catalog
from .client import Client
from .series import S, day, one_per_time, scratch, series

ORDER = ["ts", "seq"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


# rows and cells -----------------------------------------------------------------------------------------------------------


def _take(s, d):
    return rows.take(series(s, d), [5, 0, 99, 5, 700], ["seq"])


def _stacked(s, d):
    n = read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    r = read(s, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    return rows.stack({"nation": n, "region": r})


def _columns(s, d):
    p = read(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    p = rows.insert_column(p, 1, "twice", F.col("p_size") * 2)
    return rows.remove_column(rows.set_column(p, 4, F.round(F.col("p_retailprice") * 10, 2)), "p_name")


def _cells(s, d):
    n = read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return rows.push_rows(rows.set_cell(n, F.col("key") == 3, "name", "changed"), [(1000, "pushed")])


def _appended(s, d):
    e = series(s, d).select(*ORDER, "price")
    return sets.append(rows.append_where(e.filter("seq < 100"), e, "seq between 500 and 900 and price > 20"), e.filter("seq = 7"))


# casts --------------------------------------------------------------------------------------------------------------------


def _casts(s, d):
    o = read(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.col("o_custkey").cast("int").alias("cust"), F.substring("o_orderpriority", 1, 1).alias("level"), "o_orderpriority")
    c = lambda name, a, b: casts.cast(F.col(name), a, b)
    return o.select(
        "o_orderkey", c("o_orderdate", "timestamp_ntz", "double").alias("ms"), c("o_orderdate", "timestamp_ntz", "decimal(20,0)").cast("long").alias("us"), c("cust", "int", "bigint").alias("wide"),
        c("o_orderkey", "bigint", "timestamp_ntz").alias("at_us"), c("cust", "int", "double").alias("real"), c("level", "string", "int").alias("whole"), c("o_orderpriority", "string", "double").alias("none"),
        c("o_totalprice", "double", "decimal(17,3)").cast("string").alias("exact"), c("cust", "int", "boolean").alias("no_pair"), c("o_totalprice", "double", "timestamp_ntz").alias("at_s"),
    )


def _arithmetic(s, d):
    i = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_linenumber").cast("long").alias("n"), "l_returnflag", "l_linestatus")
    a = lambda x, y, sign, kind, other=None: casts.arithmetic(F.col(x), F.col(y), sign, kind, other)
    return i.select(
        "l_orderkey", "l_linenumber", "l_partkey", a("l_partkey", "n", "+", "bigint").alias("plus"), a("l_partkey", "n", "-", "bigint").alias("minus"), a("l_partkey", "n", "*", "bigint").alias("times"), a("l_partkey", "n", "/", "bigint").alias("over"),
        F.round(a("l_quantity", "n", "/", "double", "bigint"), 6).alias("real_over"), a("l_returnflag", "l_linestatus", "+", "string").alias("joined"), a("l_returnflag", "l_linestatus", "-", "string").alias("kept"), casts.compare(F.col("l_returnflag"), F.col("l_linestatus")).alias("cmp"),
    )


def _parsed(s, d):
    p = read(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "  ").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).otherwise("x1").alias("text"))
    t = F.col("text")
    return p.select("p_partkey", casts.parsed(t, "bigint").alias("whole"), casts.parsed(t, "bigint", F.lit(0)).alias("zeroed"), casts.parsed(t, "double").alias("real"), casts.parsed(F.when(F.col("p_partkey") % 2 == 0, "true").otherwise("F"), "boolean").alias("flag"), (values.is_empty(p, "text") | (F.trim("text") == "")).alias("blank"))


def _decimals(s, d):
    i = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", casts.decimal64(F.col("l_extendedprice"), 2).alias("p"), casts.decimal64(F.col("l_discount"), 4).alias("q"))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", casts.spelled(F.col("p") + F.col("q").cast("decimal(17,2)"), 2).alias("sum"), casts.spelled(F.col("p") - F.col("q"), 4).alias("difference"), casts.compare(F.col("p"), F.col("q")).alias("cmp"), casts.spelled(casts.decimal64(F.lit(0.29), 2), 2).alias("exact"), casts.spelled(casts.decimal64(-F.col("l_partkey") / 8, 2), 2).alias("half"))


# formats --------------------------------------------------------------------------------------------------------------------


def _frames(s, d):
    e = series(s, d)
    kind = T.StructType([f for f in e.schema if f.name != "obj"])
    return frames.from_frames(frames.to_frames(e, ORDER, 40, day()), kind)


def _ndjson(s, d):
    e = series(s, d).select("obj", "seq", "kind", "price")
    lines = files.to_ndjson(e, ["seq"], 50)
    back = F.from_json("line", "obj string, seq array<long>, kind array<string>, price array<double>")
    return lines.select("chunk", back.alias("r")).select("r.obj", "chunk", F.explode(F.arrays_zip("r.seq", "r.kind", "r.price")).alias("x")).select("obj", "chunk", "x.seq", "x.kind", "x.price")


def _csv(s, d):
    path = scratch(s, "csv")
    e = series(s, d).select("obj", "ts", "seq", "price", "kind")
    files.dump_csv(e, path)
    return files.read_csv_body(s, path, T.StructType([f for f in e.schema if f.name != "obj"]))


LINES = ["A,2024-01-01 00:00:00,1.5,x", "A,not a time,2,x", "", "B,2024-01-02 10:00:00.250,,y", "B,2024-01-03", "C,1704067200,7,\"a,b\"", "C,2024-01-05,seven,z"]


def _rejects(s, d):
    kind = T.StructType().add("ts", "timestamp_ntz").add("v", "double").add("note", "string")
    good, bad = files.split_rejects(files.parsed_lines(s.createDataFrame([(x,) for x in LINES], "value string"), kind))
    return good.select("obj", "ts", "v", "note").unionByName(bad.select(F.lit(None).cast("string").alias("obj"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("v"), F.col("line").alias("note")))


# catalog ------------------------------------------------------------------------------------------------------------------------

BARS = "ts DATETIME, open DOUBLE AGG_FIRST, high DOUBLE AGG_MAX, low DOUBLE AGG_MIN, n INT AGG_COUNT, mean DOUBLE AGG_AVG, close DOUBLE"
BARS_SQL = "SELECT obj, {b} AS ts, arg_min({o}, (ts, seq)) AS open, max({h}) AS high, min({h}) AS low, count(*) AS n, round(avg({h}), 6) AS mean, arg_max({h}, (ts, seq)) AS close FROM {t} GROUP BY 1, 2"


def _ticks(s, d):
    return series(s, d).select("obj", "ts", "seq", F.col("price").alias("open"), F.col("price").alias("high"), F.col("price").alias("low"), F.lit(1).cast("long").alias("n"), F.col("price").alias("mean"), F.col("price").alias("close"))


def _on_write(s, d):
    """Three batches by time, the second again partly late."""
    c, t = Catalog(s, scratch(s, "catalog")), _ticks(s, d)
    c.run(f"CREATE TABLE bars ({BARS}) WITH (round='1d')")
    for low, high in (("2024-01-01", "2024-01-10 12:00:00"), ("2024-01-10 12:00:00", "2024-01-20"), ("2024-01-05", "2024-01-06"), ("2024-01-20", "2025-01-01")):
        c.append("bars", t.filter((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz"))), seq="seq")
    return r6(c.table("bars"), "mean")


# a row is late if it comes in the third batch and its object has had a later day
ON_WRITE = f"""WITH {S}, batches AS (SELECT *, 1 AS part FROM s WHERE ts < TIMESTAMP '2024-01-10 12:00:00' UNION ALL SELECT *, 2 FROM s WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-20'
 UNION ALL SELECT *, 3 FROM s WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06' UNION ALL SELECT *, 4 FROM s WHERE ts >= TIMESTAMP '2024-01-20'),
top AS (SELECT obj, max(date_trunc('day', ts)) AS day FROM batches WHERE part < 3 GROUP BY obj),
kept AS (SELECT b.obj, b.ts, b.seq + 1000000 * part AS seq, price FROM batches b LEFT JOIN top USING (obj) WHERE part <> 3 OR day IS NULL OR date_trunc('day', ts) >= day) """ + BARS_SQL.format(b="date_trunc('day', ts)::TIMESTAMP", o="price", h="price", t="kept")


def _chained(s, d, cascade=False):
    c, t = Catalog(s, scratch(s, "catalog")), series(s, d).select("obj", "ts", "seq", "price", "kind")
    c.run("CREATE TABLE days (ts DATETIME, open DOUBLE AGG_FIRST, high DOUBLE AGG_MAX, seen INT AGG_COUNT) WITH (round='1d')")
    chan = ", chan='days: open, high, seen'" if cascade else ""
    c.run(f"CREATE TABLE hours (ts DATETIME, open DOUBLE AGG_FIRST, high DOUBLE AGG_MAX, seen INT AGG_COUNT) WITH (round='1h'{chan})")
    c.run("CREATE TABLE plain (ts DATETIME, price DOUBLE, kind TEXT)")
    c.run("CREATE TABLE raw (ts DATETIME, price DOUBLE, one INT, kind TEXT) WITH (chan='hours: price, changed_if(price, one), one')")
    for k in range(2):
        half = t.filter((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) == bool(k))
        c.append("raw", half.select("obj", "ts", "seq", "price", F.lit(1).alias("one"), "kind"), seq="seq")
    return c.table("days" if cascade else "hours")


_FED = "fed AS (SELECT obj, ts, seq, price, CASE WHEN price = lag(price) OVER (PARTITION BY obj ORDER BY ts, seq) THEN 1.0 ELSE price END AS h FROM s)"
_HOURS = "SELECT obj, date_trunc('hour', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(h) AS high, count(*) AS seen FROM fed GROUP BY 1, 2"
_FIRST = "first AS (SELECT obj, date_trunc('hour', ts) AS ts, price, h FROM fed QUALIFY row_number() OVER (PARTITION BY obj, date_trunc('hour', ts) ORDER BY ts, seq) = 1)"


def _statements(s, d):
    """Each statement's outcome as text: step and value."""
    cl = Client(s, scratch(s, "catalog"))
    c, out = cl.catalog, []
    tell = lambda step, v: out.append((step, str(v)))
    shown = lambda df: [tuple(str(x) for x in r) for r in df.collect()]
    c.sql("CREATE TABLE t (ts DATETIME, v DOUBLE, note TEXT COMMENT 'a; note') WITH (chunkSize=50); CREATE TABLE IF NOT EXISTS t (ts DATETIME, x INT); CREATE TABLE conf (k TEXT, v TEXT) WITH (engine='kv')")
    c.run("INSERT INTO t (obj, ts, v, note) VALUES ('b', '2024-01-02', 2, 'it''s'), ('a', '2024-01-01 06:00:00', 1.5, ''), ('a', '1704153600', 3, NULL)")
    c.sql("COPY t\na,2024-01-04,4,copied\n\nCOPY t HEADER\nobj,v,ts\nc,9,2024-01-05\n\nINSERT INTO conf (k, v) VALUES ('host', 'x'), ('port', '1'), ('host', 'y')")
    tell("all", shown(c.run("SELECT * FROM t")))
    tell("objects", shown(c.run("SELECT obj FROM t WHERE obj = '?'")))
    tell("window", shown(c.run("SELECT v AS w FROM t WHERE ts >= '2024-01-01' AND '2024-01-04' > ts AND obj IN ('a', 'z*') ORDER BY ts DESC LIMIT 1 OFFSET 1")))
    tell("not in", shown(c.run("SELECT v FROM t WHERE obj NOT IN ('a') AND ts BETWEEN '2024-01-01' AND '2024-01-03'")))
    tell("kv", shown(c.run("SELECT * FROM conf WHERE k IN ('ho*', 'nope')")))
    tell("tables", [r["name"] for r in c.run(".tables 't*'").collect()])
    c.run("COMMENT ON COLUMN t.v IS 'value'")
    tell("desc", shown(c.run("DESC t")))
    for bad in ("COMMENT ON COLUMN t.nope IS 'x'", "INSERT INTO t (obj, ts, v) VALUES ('a', 'never', 1)", "COPY t\na,2024-01-01,x,y", "CREATE TABLE u (ts DATETIME, v DOUBLE) WITH (chan='nowhere: v')", "SELECT * FROM t WHERE v = 1"):
        try:
            c.run(bad)
            tell("refused", False)
        except ValueError:
            tell("refused", True)
    try:
        c.run("DROP TABLE t", role=3)
    except PermissionError:
        tell("role", "admin only")
    c.run("DELETE FROM t WHERE obj = 'a' AND ts >= '2024-01-02'")
    tell("deleted", shown(c.run("SELECT v FROM t")))
    c.run("DELETE FROM conf WHERE k = 'p*'")
    tell("kv deleted", shown(c.run("SELECT * FROM conf")))
    c.run("DELETE FROM t")
    tell("emptied", c.table("t").count())
    c.run("DROP TABLE conf")
    cl.create_table("made", series(s, d).limit(1))
    tell("made", [f.name for f in cl.table_schema("made")])
    tell("left", cl.tables())
    return s.createDataFrame(out, "step string, value string")


_STEPS = [
    ("all", "[('a', '2024-01-01 06:00:00', '1.5', ''), ('a', '2024-01-02 00:00:00', '3.0', 'None'), ('a', '2024-01-04 00:00:00', '4.0', 'copied'), ('b', '2024-01-02 00:00:00', '2.0', \"it's\"), ('c', '2024-01-05 00:00:00', '9.0', 'None')]"),
    ("objects", "[('a',), ('b',), ('c',)]"), ("window", "[('a', '2024-01-01 06:00:00', '1.5')]"), ("not in", "[('b', '2024-01-02 00:00:00', '2.0')]"), ("kv", "[('host', 'y')]"), ("tables", "['t']"),
    ("desc", "[('ts', 'timestamp_ntz', 'None', 'None'), ('v', 'double', 'None', 'value'), ('note', 'string', 'None', 'a; note')]"),
    *[("refused", "True")] * 5, ("role", "admin only"), ("deleted", "[('a', '2024-01-01 06:00:00', '1.5'), ('b', '2024-01-02 00:00:00', '2.0'), ('c', '2024-01-05 00:00:00', '9.0')]"), ("kv deleted", "[('host', 'y')]"), ("emptied", "0"),
    ("made", "['obj', 'ts', 'seq', 'price', 'kind']"), ("left", "['made', 't']"),
]


def _load(s, d):
    e = series(s, d)
    hook = lambda name, df: df.withColumn("half", F.col("paid") / 2) if name == "paid" else df
    errors = e.filter("kind = 'error'").groupBy("obj", "ts").agg(F.max("price").alias("price"))
    tables = {"base": rows.fields_first(e, ["price", "seq"]), "paid": one_per_time(e), "errors": errors}
    return joins.load(tables, {"paid": "backward", "*": "zero"}, "2024-01-05", dt.datetime(2024, 1, 12), hook)


# key-value, subscriptions, updaters, streams -----------------------------------------------------------------------------------


def _kv(s, d):
    n = read(s, d, "nation")
    writes = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"), F.col("n_nationkey").cast("long").alias("seq"))
    more = kv.delete(kv.get(writes, ["*A", "N?T*", "NATION_1*"]), "NATION_12")
    life = n.select(F.col("n_name").alias("key"), F.lit("kept").alias("value"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("expire_at"))
    return more.unionByName(kv.unexpired(life, dt.datetime(2024, 6, 1)).select("key", "value"))


RULES = [streaming.Subscription("ev*", "*"), streaming.Subscription("events", "U0000*", False), streaming.Subscription("events", "U00000*"), streaming.Subscription("events", "U000003", False)]


def _updaters(s, d):
    made = {h: h for h in ("acc", "max", "min", "first", "diff_first", "diff_prev", "count", "avg", "prev", "assign")}
    return r6(updaters.carried(series(s, d).drop("kind"), made, "price", ORDER, day()), "acc", "avg", "diff_first", "diff_prev")


def _periods(s, d):
    made = {"acc": "acc", "mean": "avg", "n": "count", "high": "max", "low": "min"}
    return r6(updaters.over_periods(series(s, d).drop("kind"), made, "price", 5 * 86400, ORDER), "acc", "mean")


def _stream(s, d):
    """The stream in micro-batches of one span of time each, however many files it has, then the last row of each bucket."""
    path = scratch(s, "stream")
    e = series(s, d).select("obj", "ts", "seq", "price", "kind")
    aggs = {"price AS open": "first", "price AS high": "max", "price AS low": "min", "price AS n": "count", "kind AS kinds": "uniq_count", "price AS step": "diff_prev", "price AS close": "latest"}
    for low, high in (("2024-01-01", "2024-01-10 12:00:00"), ("2024-01-10 12:00:00", "2024-01-21"), ("2024-01-21", "2100-01-01")):
        e.filter((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz"))).write.mode("append").parquet(f"{path}/in")
        src = s.readStream.schema("obj string, ts timestamp_ntz, seq long, price double, kind string").parquet(f"{path}/in")
        got = state.exact_rollup(src, "1d", aggs)
        q = streaming.fan_out(got, {"bars": lambda b: b}, lambda name, b, k: b.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/out/batch={k}"), f"{path}/checkpoint")
        q.awaitTermination()  # all there is, then the next goes on from the checkpoint
    out = s.read.parquet(f"{path}/out")
    last = out.groupBy("obj", "ts").agg(F.max_by(F.struct("open", "high", "low", "n", "kinds", "step", "close"), F.struct("n", "batch")).alias("r"))
    return r6(last.select("obj", "ts", "r.*"), "step")


def _windows(s, d):
    e = series(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    got = streaming.sliding(e, "2 days", "1 day", {"n": F.count("*"), "high": F.max("price")})
    return got.select("obj", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", "high")


def _sessions(s, d):
    e = series(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    got = streaming.sessions(e, "12 hours", {"n": F.count("*"), "low": F.min("price")})
    return got.select("obj", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", "low")


QUERIES = {
    "prefix_scan": lambda s, d: scan.prefix(read(s, d, "customer"), "c_name", "Customer#0000000", desc=True, limit=25),
    "point_get": lambda s, d: scan.point(read(s, d, "part"), "p_partkey", 7),
    "next_key": lambda s, d: scan.next_key(read(s, d, "orders").filter("o_orderkey % 7 = 0"), "o_orderkey", 100),
    "order_global": lambda s, d: scan.ordered(series(s, d).filter("kind = 'error'"), desc=True),
    "requests_per_object": lambda s, d: scan.requests({"events": series(s, d), "purchases": one_per_time(series(s, d))}, "U0000*", 5),
    "route_objects": lambda s, d: rows.route(scan.list_objects(series(s, d)), "obj", 8),
    "object_runs": lambda s, d: rows.runs(series(s, d).withColumn("key", F.substring("obj", 1, 6)), "key", ["seq"]),
    "group_rows": lambda s, d: rows.group_rows(series(s, d), "kind", ["seq"]),
    "take_rows": _take,
    "reverse_rows": lambda s, d: rows.reverse(series(s, d), ORDER, day()),
    "chunk_rows": lambda s, d: rows.chunked(series(s, d), 37, ORDER, ("obj",), day()),
    "chunks_in_range": lambda s, d: scan.overlapping(scan.chunk_report(series(s, d), 20, ORDER), "2024-01-10", "2024-01-12"),
    "row_at": lambda s, d: rows.row_at(series(s, d), 123, ORDER, day()),
    "stack_objects": _stacked,
    "append_filtered": _appended,
    "column_ops": _columns,
    "cell_ops": _cells,
    "preview_rows": lambda s, d: files.preview(series(s, d), 5, ORDER, day()),
    "cast_matrix": _casts,
    "cell_arithmetic": _arithmetic,
    "parse_typed": _parsed,
    "decimal_arithmetic": _decimals,
    "frames_round_trip": _frames,
    "ndjson_objects": _ndjson,
    "csv_round_trip": _csv,
    "csv_rejects": _rejects,
    "statements": _statements,
    "rollup_on_write": _on_write,
    "chain_on_write": _chained,
    "chain_cascade": lambda s, d: _chained(s, d, True),
    "load_fold": _load,
    "kv_patterns": _kv,
    "subscription_filter": lambda s, d: streaming.wanted(streaming.notices(series(s, d), "events"), RULES).select("table", "obj", "count"),
    "updaters_carried": _updaters,
    "updaters_by_period": _periods,
    "stream_rollup_exact": _stream,
    "window_sliding": _windows,
    "window_session": _sessions,
}

_DAY = "date_trunc('day', ts)::TIMESTAMP"
_W = "OVER (PARTITION BY obj ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
_P = "OVER (PARTITION BY obj, start ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
ORACLE_SQL = {
    "prefix_scan": "SELECT * FROM customer WHERE c_name LIKE 'Customer#0000000%' ORDER BY c_name DESC LIMIT 25",
    "point_get": "SELECT * FROM part WHERE p_partkey = 7",
    "next_key": "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey % 7 = 0 ORDER BY o_orderkey LIMIT 1",
    "order_global": f"WITH {S} SELECT * FROM s WHERE kind = 'error' ORDER BY obj, ts DESC",
    "requests_per_object": f"WITH {S} SELECT DISTINCT 'events' AS \"table\", obj, 5::BIGINT AS \"limit\" FROM s WHERE obj LIKE 'U0000%' UNION ALL SELECT DISTINCT 'purchases', obj, 5 FROM s WHERE obj LIKE 'U0000%' AND kind = 'purchase'",
    "route_objects": f"WITH {S} SELECT DISTINCT obj, ('0x' || substr(md5(obj), 1, 8))::BIGINT % 8 AS worker FROM s",
    "object_runs": f"WITH {S}, k AS (SELECT seq, substr(obj, 1, 6) AS key FROM s), n AS (SELECT key, row_number() OVER (ORDER BY seq) - 1 AS pos, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS own FROM k) SELECT min(pos) AS start, key, count(*) AS rows FROM n GROUP BY key, pos - own",
    "group_rows": f"WITH {S} SELECT kind AS \"group\", row_number() OVER (PARTITION BY kind ORDER BY seq) - 1 AS pos, obj, ts, seq, price FROM s",
    "take_rows": f"WITH {S}, n AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos FROM s) SELECT n.obj, n.ts, n.seq, n.price, n.kind, l.\"at\"::BIGINT AS \"at\" FROM (VALUES (0, 5), (1, 0), (2, 99), (3, 5), (4, 700)) l(\"at\", pos) JOIN n USING (pos)",
    "reverse_rows": f"WITH {S} SELECT *, row_number() OVER (ORDER BY ts DESC, seq DESC) - 1 AS pos FROM s",
    "chunk_rows": f"WITH {S} SELECT *, (row_number() {_W} - 1) // 37 AS chunk, (row_number() {_W} - 1) % 37 AS place FROM s".replace(" ROWS UNBOUNDED PRECEDING", ""),
    "chunks_in_range": f"WITH {S} SELECT * FROM (SELECT obj, chunk, min(ts) AS start, max(ts) AS \"end\", count(*) AS count FROM (SELECT obj, ts, (row_number() OVER (PARTITION BY obj ORDER BY ts, seq) - 1) // 20 AS chunk FROM s) GROUP BY 1, 2) WHERE \"end\" >= TIMESTAMP '2024-01-10' AND start < TIMESTAMP '2024-01-12'",
    "row_at": f"WITH {S} SELECT * FROM s ORDER BY ts, seq LIMIT 1 OFFSET 123",
    "stack_objects": "SELECT 'nation' AS obj, n_nationkey::BIGINT AS key, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region",
    "append_filtered": f"WITH {S} SELECT ts, seq, price FROM s WHERE seq < 100 UNION ALL SELECT ts, seq, price FROM s WHERE seq BETWEEN 500 AND 900 AND price > 20 UNION ALL SELECT ts, seq, price FROM s WHERE seq = 7",
    "column_ops": "SELECT p_partkey, p_size * 2 AS twice, p_size, round(p_retailprice * 10, 2) AS p_retailprice FROM part",
    "cell_ops": "SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_name END AS name FROM nation UNION ALL SELECT 1000, 'pushed'",
    "preview_rows": f"WITH {S} SELECT no, obj, ts, seq, price, kind FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY ts, seq) AS no, count(*) OVER (PARTITION BY obj) AS many FROM s) WHERE no <= 2 OR no > many - 3",
    "cast_matrix": "SELECT o_orderkey, epoch_us(o_orderdate) / 1000 AS ms, epoch_us(o_orderdate) AS us, o_custkey AS wide, make_timestamp(o_orderkey) AS at_us, o_custkey::DOUBLE AS real, substr(o_orderpriority, 1, 1)::INT AS whole, NULL::DOUBLE AS none, o_totalprice::DECIMAL(17,3)::VARCHAR AS exact, NULL::BOOLEAN AS no_pair, make_timestamp(trunc(o_totalprice * 1000000)::BIGINT) AS at_s FROM orders",
    "cell_arithmetic": "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey + l_linenumber AS plus, l_partkey - l_linenumber AS minus, l_partkey * l_linenumber AS times, l_partkey // l_linenumber AS over, round(l_quantity / l_linenumber, 6) AS real_over, l_returnflag || l_linestatus AS joined, l_returnflag AS kept, CASE WHEN l_returnflag = l_linestatus THEN 0 WHEN l_returnflag < l_linestatus THEN -1 ELSE 1 END AS cmp FROM lineitem",
    "parse_typed": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_size::BIGINT END AS whole, CASE WHEN p_partkey % 3 = 1 THEN p_size::BIGINT ELSE 0 END AS zeroed, CASE WHEN p_partkey % 3 = 1 THEN p_size::DOUBLE END AS real, p_partkey % 2 = 0 AS flag, p_partkey % 3 = 0 AS blank FROM part",
    "decimal_arithmetic": "SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice::DECIMAL(17,2) + l_discount::DECIMAL(17,2))::DECIMAL(17,2)::VARCHAR AS sum, (l_extendedprice::DECIMAL(17,2) - l_discount::DECIMAL(17,4))::DECIMAL(17,4)::VARCHAR AS difference, CASE WHEN l_extendedprice = l_discount THEN 0 WHEN l_extendedprice < l_discount THEN -1 ELSE 1 END AS cmp, '0.29' AS exact, round(-(l_partkey::DECIMAL(17,3)) * 0.125, 2)::DECIMAL(17,2)::VARCHAR AS half FROM lineitem",
    "frames_round_trip": f"WITH {S} SELECT * FROM s",
    "ndjson_objects": f"WITH {S} SELECT obj, (row_number() OVER (PARTITION BY obj ORDER BY seq) - 1) // 50 AS chunk, seq, kind, price FROM s",
    "csv_round_trip": f"WITH {S} SELECT * FROM s",
    "csv_rejects": "SELECT * FROM (VALUES ('A', TIMESTAMP '2024-01-01', 1.5::DOUBLE, 'x'), ('B', TIMESTAMP '2024-01-02 10:00:00.25', NULL, 'y'), ('C', TIMESTAMP '2024-01-01', 7, 'a,b'), (NULL, NULL, NULL, 'A,not a time,2,x'), (NULL, NULL, NULL, 'B,2024-01-03'), (NULL, NULL, NULL, 'C,2024-01-05,seven,z')) v(obj, ts, v, note)",
    "statements": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in _STEPS) + ") v(step, value)",
    "rollup_on_write": ON_WRITE,
    "chain_on_write": f"WITH {S}, {_FED} {_HOURS}",
    "chain_cascade": f"WITH {S}, {_FED}, {_FIRST} SELECT obj, {_DAY} AS ts, arg_min(price, ts) AS open, max(h) AS high, count(*) AS seen FROM first GROUP BY 1, 2",
    "load_fold": f"WITH {S}, p AS (SELECT obj, ts, max(price) AS paid FROM s WHERE kind = 'purchase' GROUP BY obj, ts), e AS (SELECT obj, ts, max(price) AS price FROM s WHERE kind = 'error' GROUP BY obj, ts), b AS (SELECT l.obj, l.ts, l.price, l.seq, p.paid, p.paid / 2 AS half FROM s l ASOF LEFT JOIN p ON l.obj = p.obj AND l.ts >= p.ts WHERE l.ts >= TIMESTAMP '2024-01-05' AND l.ts < TIMESTAMP '2024-01-12') SELECT b.obj, b.ts, b.price, b.seq, b.paid, b.half, coalesce(e.price, 0) AS price_errors FROM b LEFT JOIN e ON b.obj = e.obj AND b.ts = e.ts",
    "kv_patterns": "SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE (n_name LIKE '%A' OR n_name LIKE 'N_T%' OR n_name LIKE 'NATION\\_1%' ESCAPE '\\') AND n_name <> 'NATION_12' UNION ALL SELECT n_name, 'kept' FROM nation WHERE n_nationkey % 2 = 1",
    "subscription_filter": f"WITH {S} SELECT 'events' AS \"table\", obj, count(*) AS count FROM s WHERE obj NOT LIKE 'U0000%' OR obj LIKE 'U00000%' AND obj <> 'U000003' GROUP BY obj",
    "updaters_carried": f"WITH {S} SELECT obj, ts, seq, price, round(sum(price) {_W}, 6) AS acc, max(price) {_W} AS max, min(price) {_W} AS min, first(price) {_W} AS first, round(price - first(price) {_W}, 6) AS diff_first, round(price - lag(price) OVER (PARTITION BY obj ORDER BY ts, seq), 6) AS diff_prev, count(price) {_W} AS count, round(avg(price) {_W}, 6) AS avg, lag(price) OVER (PARTITION BY obj ORDER BY ts, seq) AS prev, price AS assign FROM s",
    "updaters_by_period": f"WITH RECURSIVE {S}, o AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY ts, seq) AS n FROM s), r AS (SELECT obj, n, ts AS start, 0::BIGINT AS period FROM o WHERE n = 1 UNION ALL SELECT o.obj, o.n, CASE WHEN r.start + INTERVAL 5 DAY < o.ts THEN o.ts ELSE r.start END, r.period + CASE WHEN r.start + INTERVAL 5 DAY < o.ts THEN 1 ELSE 0 END FROM r JOIN o ON o.obj = r.obj AND o.n = r.n + 1) SELECT o.obj, ts, seq, price, period, start AS period_start, round(sum(price) {_P}, 6) AS acc, round(avg(price) {_P}, 6) AS mean, count(price) {_P} AS n, max(price) {_P} AS high, min(price) {_P} AS low FROM o JOIN r ON o.obj = r.obj AND o.n = r.n".replace("PARTITION BY obj, start", "PARTITION BY o.obj, start"),
    "stream_rollup_exact": f"WITH {S}, x AS (SELECT *, price - lag(price) OVER (PARTITION BY obj, {_DAY} ORDER BY ts, seq) AS d FROM s) SELECT obj, {_DAY} AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, count(*) AS n, count(DISTINCT kind) AS kinds, round(arg_max(struct_pack(v := d), (ts, seq)).v, 6) AS step, arg_max(price, (ts, seq)) AS close FROM x GROUP BY 1, 2",
    "window_sliding": f"WITH {S}, w AS (SELECT obj, price, unnest([{_DAY}, {_DAY} - INTERVAL 1 DAY]) AS start FROM s) SELECT obj, start, start + INTERVAL 2 DAY AS \"end\", count(*) AS n, max(price) AS high FROM w GROUP BY obj, start",
    "window_session": f"WITH {S}, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY obj ORDER BY ts, seq) > INTERVAL 12 HOUR, true)::INT AS new FROM s), n AS (SELECT *, sum(new) {_W} AS k FROM g) SELECT obj, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n, min(price) AS low FROM n GROUP BY obj, k",
}
