import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.time import parse_datetime, parse_duration, parse_unit, round_ts
from tidemark.functions.values import matches, matches_any
from tidemark.operators import chain, joins, rollup
from tidemark.sources import files
from tidemark.streaming import rollup as streaming

D = lambda day, *rest: dt.datetime(2024, 1, day, *rest)


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("method", ["backward", "forward", "nearest"])
def test_asof_equals_pandas(spark, method):
    left = pd.DataFrame({"obj": ["a", "b"] * 150, "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta([k * 7919 % 400_000 for k in range(300)], "s"), "v": range(300)})
    right = pd.DataFrame({"obj": ["a", "b", "b"] * 20, "ts": pd.to_datetime("2024-01-02") + pd.to_timedelta([k * 6007 % 200_000 for k in range(60)], "s"), "w": [float(k) for k in range(60)]})
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), "ts", by="obj", direction=method)
    as_ntz = lambda p, c: spark.createDataFrame(p).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select("obj", "ts", c)
    got = joins.asof(as_ntz(left, "v"), as_ntz(right, "w"), method).toPandas()
    assert dict(zip(got.v, got.w.fillna(-1))) == dict(zip(want.v, want.w.fillna(-1)))


def test_clashing_columns_and_zero_fill(spark):
    left = frame(spark, [("a", D(1), 1.0), ("a", D(2), 2.0)], "obj string, ts timestamp_ntz, v double")
    right = frame(spark, [("a", D(1), 9.0)], "obj string, ts timestamp_ntz, v double")
    got = joins.load({"l": left, "r": right}, {"*": "zero"})
    assert sorted((r["v"], r["v_r"]) for r in got.collect()) == [(1, 9), (2, 0)]
    with pytest.raises(ValueError):
        joins.join(left, right, "sideways")


def test_rollup_skips_empty_values(spark):
    nan = float("nan")
    df = frame(spark, [("a", D(1, 1), 1, 5.0), ("a", D(1, 2), 2, nan), ("a", D(1, 3), 3, None), ("b", D(1), 4, nan)], "obj string, ts timestamp_ntz, seq long, v double")
    got = {r["obj"]: r for r in rollup.rollup(df, "1d", {"v AS hi": "max", "v AS last": "latest", "v AS n": "count"}).collect()}
    assert (got["a"]["hi"], got["a"]["last"], got["a"]["n"]) == (5, 5, 3) and got["b"]["hi"] is None


def test_drop_late_is_the_same_for_any_block(spark):
    df = frame(spark, [("a", k, (k * 37) % 50) for k in range(200)], "obj string, seq long, bucket int")
    best, want = -1, []
    for k in range(200):
        if (b := k * 37 % 50) >= best:
            want.append(k)
            best = b
    for block in (1, 7, 1000):
        assert sorted(r["seq"] for r in rollup.drop_late(df, block=block).collect()) == want


def test_chain_rules(spark):
    rule = chain.parse_rule("t1, t2: open, changed_if(High, close)")
    assert rule.targets == ("t1", "t2")
    df = frame(spark, [("a", D(k), 1.0, h, 0.0) for k, h in ((1, 5.0), (2, 5.0), (3, 6.0))], "obj string, ts timestamp_ntz, open double, high double, close double")
    assert [r["h"] for r in chain.project(df, rule, ["o", "h"], ["ts"]).orderBy("ts").collect()] == [5, 0, 6]
    with pytest.raises(ValueError):
        chain.cascade_order({"a": chain.parse_rule("b: x"), "b": chain.parse_rule("a: x")})
    assert chain.cascade_order({"a": chain.parse_rule("b: x"), "b": chain.parse_rule("c: x")}) == ["a", "b", "c"]


def test_time(spark):
    assert parse_unit("15m") == (15, "m") and parse_duration("1.5h") == 5400
    with pytest.raises(ValueError):
        parse_unit("5q")
    df = frame(spark, [(dt.datetime(1969, 12, 31, 23, 59, 59),), (dt.datetime(2022, 4, 21, 20, 20, 30),)], "ts timestamp_ntz")
    got = [tuple(r) for r in df.select(*[round_ts("ts", u, 28800) for u in ("1h", "1d", "1w", "1M", "1y")]).collect()]
    local = [t + dt.timedelta(hours=8) for t in got[1]]
    assert local == [dt.datetime(2022, 4, 22, 4), dt.datetime(2022, 4, 22), dt.datetime(2022, 4, 18), dt.datetime(2022, 4, 1), dt.datetime(2022, 1, 1)]
    assert got[0][0] == dt.datetime(1969, 12, 31, 23)
    texts = ["1650572430", "1650572430000", "1650572430000000", "1650572430000000000", "2022-04-22T04:20:30.000", "2022/4/22 04:20:30+08", "2022-04-21 20:20:30Z", "junk", "", None]
    got = [r[0] for r in frame(spark, [(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(parse_datetime("t", 28800)).collect()]
    assert got[:7] == [dt.datetime(2022, 4, 21, 20, 20, 30)] * 7 and got[7:] == [None] * 3


def test_patterns(spark):
    df = frame(spark, [("a_1",), ("ab1",), ("a%",), ("A_1",)], "obj string")
    hits = lambda c: sorted(r[0] for r in df.filter(c).collect())
    assert hits(matches("obj", "a_?")) == ["a_1"] and hits(matches("obj", "a*")) == ["a%", "a_1", "ab1"]
    assert hits(matches_any("obj", ["A_1", "*%"])) == ["A_1", "a%"] and hits(matches_any("obj", "")) == ["A_1", "a%", "a_1", "ab1"]


def test_csv_and_parquet(spark, tmp_path):
    (tmp_path / "in.csv").write_text("skip me\n\na,2024-01-01 00:00:00,1.5\nb,2024-01-02 00:00:00,2.5\n")
    got = files.read_csv_body(spark, str(tmp_path / "in.csv"), T.StructType().add("ts", "timestamp_ntz").add("v", "double"), skip=1)
    assert sorted((r["obj"], r["v"]) for r in got.collect()) == [("a", 1.5), ("b", 2.5)]
    files.write_series(got, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    files.write_csv(got, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    assert files.from_memory(spark, "x", [("v", [1, 2])]).collect()[0]["obj"] == "x"


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("string").alias("obj"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    aggs = {"value AS first": "first", "value AS high": "max", "value AS n": "count", "value AS close": "latest"}
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = streaming.stream_rollup(stream, "1d", aggs, "40 days").writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = rollup.rollup(src.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "1d", aggs)
    key = lambda r: (r["obj"], str(r["ts"]), r["first"], r["high"], r["n"], r["close"])
    assert sorted(map(key, spark.table("bars").collect())) == sorted(map(key, batch.collect()))


def test_fan_out(spark, tmp_path):
    src = spark.range(10).select(F.lit("a").alias("obj"), F.col("id").alias("v"))
    src.write.parquet(str(tmp_path / "in"))
    write = lambda name, rows, batch: rows.write.mode("overwrite").parquet(f"{tmp_path}/{name}/{batch}")
    streaming.fan_out(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), {"even": lambda d: d.filter("v % 2 = 0"), "all": lambda d: d}, write, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/even/0").count() == 5 and spark.read.parquet(f"{tmp_path}/all/0").count() == 10


def test_subscriptions():
    S = streaming.Subscription
    rules = [S("bars*", "*"), S("bars", "SH*", False), S("bars", "SH60*"), S("bars", "SH601", False)]
    got = [streaming.subscribed(rules, t, o) for t, o in (("bars1d", "SH1"), ("bars", "SH1"), ("bars", "SH600"), ("bars", "SH601"), ("other", "x"))]
    assert got == [True, False, True, False, False]
