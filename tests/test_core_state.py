import datetime as dt
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import casts
from tidemark.operators import chain, joins, rollup, rows, scan
from tidemark.plans.catalog import Catalog, StatementError
from tidemark.plans.client import Client
from tidemark.sources import files, frames
from tidemark.streaming import rollup as streaming
from tidemark.streaming import state

D = lambda day, *rest: dt.datetime(2024, 1, day, *rest)


@pytest.mark.parametrize("method", ["backward", "forward", "nearest"])
def test_left_rows_without_keys_stay(spark, method):
    left = spark.createDataFrame([("a", D(2), 1), (None, D(2), 2), ("a", None, 3)], "obj string, ts timestamp_ntz, v int")
    right = spark.createDataFrame([("a", D(2), 9), (None, D(2), 8), ("a", None, 7)], "obj string, ts timestamp_ntz, w int")
    assert sorted((r["v"], r["w"]) for r in joins.asof(left, right, method).collect()) == [(1, 9), (2, None), (3, None)]


def test_ties_of_one_time(spark):
    left = spark.createDataFrame([("a", D(2), 1)], "obj string, ts timestamp_ntz, v int")
    right = spark.createDataFrame([("a", D(2), k) for k in (5, 7, 6)], "obj string, ts timestamp_ntz, w int")
    assert [joins.asof(left, right, m, tie="w").first()["w"] for m in ("backward", "forward")] == [7, 5]


def test_late_filter_keeps_rows_beside_those_without_numbers(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 5), (None, 2, 1), ("a", 3, None)], "obj string, seq long, bucket int")
    assert sorted((str(r["obj"]), str(r["seq"])) for r in rollup.drop_late(df).collect()) == [("None", "2"), ("a", "1"), ("a", "None")]


def test_numbers_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame([("ab"[k % 2], k * 37 % 100) for k in range(100)], "obj string, seq long")
    for size in (1, 7, 1000):
        block = F.floor(F.col("seq") / size)
        assert [r["pos"] for r in rows.numbered(df, ["seq"], block=block).orderBy("seq").collect()] == list(range(100))
        assert sum(r["chunk"] for r in rows.chunked(df, 10, ["seq"], ("obj",), block).collect()) == 2 * sum(k // 10 for k in range(50))


def test_writers_and_versions(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.run("CREATE TABLE t (ts DATETIME, v DOUBLE)")
    old = c.meta("t")
    c.run("INSERT INTO t (obj, ts, v) VALUES ('a', '2024-01-01', 1)")
    with pytest.raises(Exception):  # noqa: B017 - another writer has made this version
        c._keep(old)
    c.run("INSERT INTO t (obj, ts, v) VALUES ('a', '2024-01-02', 2)")
    c.compact("t")
    assert len(c.meta("t")["parts"]) == 1 and c.table("t").count() == 2
    plan = c.run("SELECT v FROM t WHERE ts >= '2024-01-02' AND obj = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(obj,a)" in plan and "GreaterThanOrEqual(ts" in plan
    with pytest.raises(StatementError):
        c.run("COMMENT ON COLUMN t.none IS 'x'")
    c.run("CREATE TABLE u (ts DATETIME, v DOUBLE) WITH (chan='t: v')")
    with pytest.raises((StatementError, ValueError)):
        c.run("CREATE TABLE w (ts DATETIME, v DOUBLE) WITH (chan='t: v, v')")


def test_chains_go_on_after_a_crash(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path))
    c.sql("CREATE TABLE v (ts DATETIME, x DOUBLE); CREATE TABLE u (ts DATETIME, x DOUBLE) WITH (chan='v: x'); CREATE TABLE w (ts DATETIME, x DOUBLE)")
    c.run("CREATE TABLE t (ts DATETIME, x DOUBLE) WITH (chan='u,w: x')")
    values = lambda n: sorted(r["x"] for r in c.table(n).collect())
    keep, budget = Catalog._keep, [0]

    def dies(self, meta):
        if not budget[0]:
            raise RuntimeError("crash")
        budget[0] -= 1
        keep(self, meta)

    for k in range(6):  # the writer dies after its k-th version: none, of t, u, v, u again, w
        with monkeypatch.context() as mp:
            mp.setattr(Catalog, "_keep", dies)
            budget[0] = k
            with pytest.raises(RuntimeError):
                c.run(f"INSERT INTO t (obj, ts, x) VALUES ('a', '2024-01-0{k + 1}', {k})")
        c.recover()
        assert values("u") == values("v") == values("w") == values("t") == [float(i) for i in range(1, k + 1)]
    c.run("INSERT INTO t (obj, ts, x) VALUES ('a', '2024-01-09', 9)")
    assert values("u") == values("v") == values("w") == values("t") == [1, 2, 3, 4, 5, 9]


def test_ties_of_one_time_arrive_by_number(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.sql("CREATE TABLE h (ts DATETIME, x DOUBLE AGG_FIRST, n INT AGG_COUNT) WITH (round='1h')")
    c.run("CREATE TABLE t (ts DATETIME, x DOUBLE, one INT) WITH (chan='h: changed_if(x, one), one')")
    df = spark.createDataFrame([("a", D(k // 8 + 1), -k, float(k // 2), 100 + k) for k in range(16)], "obj string, ts timestamp_ntz, seq long, x double, one long")
    c.append("t", df.repartition(5), seq="seq")  # the last row of a time comes first
    assert [(r["ts"], r["x"], r["n"]) for r in c.table("h").orderBy("ts").collect()] == [(D(1), 3.0, 8), (D(2), 7.0, 8)]
    assert not list(tmp_path.glob("data/*-work/*"))


def test_rows_before_are_found_without_a_join(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 9, "y"), (None, 3, "z"), (None, 8, "w"), ("b", 5, "v")], "obj string, seq long, v string")
    for size in (1, 4, 100):
        got = rows.previous(df, ["v"], ["seq"], F.floor(F.col("seq") / size))
        assert {r["seq"]: r["_previous"] and r["_previous"]["v"] for r in got.collect()} == {1: None, 2: "x", 9: None, 3: None, 8: "z", 5: None}
        assert {r["seq"] for r in got.filter("_previous IS NULL").collect()} == {1, 3, 5}
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_client(spark, tmp_path):
    cl = Client(spark, str(tmp_path / "cat"))
    df = spark.createDataFrame([("a", D(k), float(k)) for k in range(1, 5)] + [("b", D(1), 9.0)], "obj string, ts timestamp_ntz, v double")
    cl.create_table("t", df)
    assert cl.save("t", df)["total_rows"] == 5
    assert cl.load("a", "t", fields=["v"], start="2024-01-02", end="2024-01-04")["t"].count() == 2
    assert cl.verb(".rows t 2").count() == 3 and cl.tables() == ["t"] and cl.table_schema("nope") is None
    cl.verb(f".dump t {tmp_path}/csv")
    cl.run = cl.query("CREATE TABLE u (ts DATETIME, v DOUBLE)")
    assert cl.verb(f".import u {tmp_path}/csv")["total_rows"] == 5
    assert cl.save("u", [("c", [("ts", [D(9)]), ("v", [1.0])])])["total_rows"] == 1
    assert sorted(cl.by_object(cl.query("SELECT * FROM u"))) == ["a", "b", "c"]
    assert cl.async_query("SELECT obj FROM t").result(60).count() == 2
    cl.set_time_zone(3600)
    assert cl.local(df).first()["ts"] == D(1, 1) and "columns" in cl.describe_tables()[0]


def test_frames(spark):
    data = frames.pack(pa.table({"x": [1, 2]}))
    assert frames.unpack(data).to_pydict() == {"x": [1, 2]} and frames.check(data)[0] == 8
    for bad in (b"", b"\0" * 20, data[:-1], data[:-1] + bytes([data[-1] ^ 1])):
        with pytest.raises(frames.FrameError):
            frames.unpack(bad)
    assert frames.empty(spark, '{"version": 1, "columns": [{"name": "ts", "kind": "DateTime"}, {"name": "v", "kind": "UInt32"}]}').dtypes == [("ts", "timestamp_ntz"), ("v", "bigint")]
    df = spark.createDataFrame([("a", D(1), 1.0)], "obj string, ts timestamp_ntz, v double")
    assert [n for n, t in frames.each_frame(frames.to_frames(df, ["ts"], block=F.lit(0)))] == ["a"]


def test_rejected_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,2024-01-01,1\nb,never,2\n")
    kind = T.StructType().add("ts", "timestamp_ntz").add("v", "double")
    with pytest.raises(Exception, match="not a row"):
        files.read_csv_body(spark, str(tmp_path / "in.csv"), kind).collect()
    assert files.read_csv_body(spark, str(tmp_path / "in.csv"), kind, rejects=str(tmp_path / "bad")).count() == 1
    assert spark.read.text(str(tmp_path / "bad")).first()[0] == "b,never,2"
    assert files.Rows(spark.range(3)).column("id") == [0, 1, 2]


def test_streams_keep_state_over_restarts(spark, tmp_path):
    src = lambda: spark.readStream.schema("obj string, ts timestamp_ntz, seq long, v double").parquet(str(tmp_path / "in"))
    rule, seen = chain.parse_rule("t: changed_if(v, seq)"), []
    write = lambda name, b, k: seen.extend((name, *r) for r in b.collect())
    for part in ([("a", D(1, 1), 1, 5.0), ("a", D(1, 2), 2, 7.0)], [("a", D(1, 3), 3, 7.0), ("a", D(2), 4, 1.0)], [("a", D(1), 5, 100.0)]):
        spark.createDataFrame(part, "obj string, ts timestamp_ntz, seq long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
        bars = state.exact_rollup(src(), "1d", {"v AS total": "sum", "v AS step": "diff_prev", "v AS kinds": "uniq_count"})
        streaming.fan_out(bars, {"bars": lambda b: b}, write, str(tmp_path / "one")).awaitTermination(60)
        streaming.fan_out(state.exact_chain(src(), rule, ["x"]), {"chain": lambda b: b}, write, str(tmp_path / "two")).awaitTermination(60)
    assert [r[3:] for r in seen if r[0] == "bars"] == [(12.0, 2.0, 2), (19.0, 0.0, 2), (1.0, None, 1), (1.0, None, 1)]  # a late row changes nothing
    assert sorted((r[3], r[4]) for r in seen if r[0] == "chain") == [(1, 5.0), (2, 7.0), (3, 3.0), (4, 1.0), (5, 100.0)]


def test_streams_call_python_by_shard_and_keep_whole_numbers(spark, tmp_path):
    big, seen = 1 << 60, {}
    df = spark.range(3000).select(F.format_string("o%04d", "id").alias("obj"), F.lit(D(1)).alias("ts"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("seq"), F.when(F.col("id") % 5 > 0, F.col("id") + big).alias("v"))
    df.write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams = {"bars": state.exact_rollup(src(), "1d", {"v AS high": "max", "v AS n": "count"}), "chain": state.exact_chain(src(), chain.parse_rule("t: changed_if(v, seq)"), ["x"])}
    for name, got in streams.items():
        q = streaming.fan_out(got, {name: lambda b: b}, lambda n, b, k: seen.setdefault(n, []).extend(b.collect()), str(tmp_path / name))
        q.awaitTermination(60)
        assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= state.SHARDS
    whole = [big + k if k % 5 else None for k in range(3000)]
    assert [r["high"] for r in sorted(seen["bars"], key=lambda r: r["obj"])] == whole == [r["x"] for r in sorted(seen["chain"], key=lambda r: r["obj"])]


def test_feed_and_windows(spark):
    feed = streaming.Feed(2)
    assert [feed.offer(k) for k in range(3)] == [True, True, False] and feed.take() == [0, 1] and feed.dropped == 1
    with pytest.raises(ValueError):
        streaming.stream_rollup(spark.createDataFrame([("a", D(1), 1, 1)], "obj string, ts timestamp, seq long, v int"), "1d", {"v": "uniq_count"})


def test_strict_casts_and_prefixes(spark):
    df = spark.createDataFrame([("ab",), ("ac",), ("b",)], "k string")
    assert [r["k"] for r in scan.prefix(df, "k", "a", desc=True, limit=1).collect()] == ["ac"]
    with pytest.raises(ValueError):
        casts.cast(F.lit(True), "boolean", "double", strict=True)
    with pytest.raises(Exception):  # noqa: B017
        df.select(casts.cast(F.col("k"), "string", "int", strict=True)).collect()
    assert df.select(casts.cast(F.col("k"), "string", "int")).first()[0] is None
