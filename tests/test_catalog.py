import datetime as dt

import pytest

from tidemark.plans.catalog import Catalog, StatementError


@pytest.fixture
def cat(spark, tmp_path):
    return Catalog(spark, str(tmp_path))


BARS = "CREATE TABLE bars (ts DATETIME, open DOUBLE AGG_FIRST, high DOUBLE AGG_MAX, low DOUBLE AGG_MIN COMMENT 'least', n INT AGG_COUNT, close DOUBLE) WITH (round='1m', chunkSize=250)"


def test_rollup_table(cat):
    cat.run(BARS)
    cat.run(BARS)  # one that exists stays
    cat.run("INSERT INTO bars (obj, ts, open, high, low, n, close) VALUES ('A', '2024-01-01 09:30:00', 5, 5, 5, 1, 5), ('A', '2024-01-01 09:30:30', 3, 3, 3, 1, 3), ('A', '2024-01-01 09:31:00', 4, 4, 4, 1, 4)")
    cat.run("INSERT INTO bars (obj, ts, open, high, low, n, close) VALUES ('B', '2024-01-01 09:30:10', 7, 7, 7, 1, 7), ('A', '2024-01-01 09:30:59', 1, 1, 1, 1, 1)")
    got = [tuple(r) for r in cat.run("SELECT * FROM bars WHERE obj = 'A*' ORDER BY ts").collect()]
    assert got == [("A", dt.datetime(2024, 1, 1, 9, 30), 5, 5, 3, 2, 3), ("A", dt.datetime(2024, 1, 1, 9, 31), 4, 4, 4, 1, 4)]  # the late row is dropped
    assert [r["obj"] for r in cat.run("SELECT obj FROM bars").collect()] == ["A", "B"]
    assert cat.run("SELECT close AS c FROM bars WHERE ts BETWEEN '2024-01-01 09:31:00' AND '2024-01-02' AND obj NOT IN ('B')").columns == ["obj", "ts", "c"]
    assert len(cat.run("SELECT * FROM bars ORDER BY ts DESC LIMIT 1").collect()) == 2
    assert {r["name"]: (r["agg"], r["desc"]) for r in cat.run("DESC bars").collect()}["low"] == ("min", "least")


def test_delete_comment_and_drop(cat):
    cat.sql("CREATE TABLE t (ts DATETIME, v DOUBLE); INSERT INTO t (obj, ts, v) VALUES ('A', '2024-01-01', 1), ('A', '2024-01-02', 2), ('B', '2024-01-01', 3)")
    cat.run("DELETE FROM t WHERE obj = 'A' AND ts < '2024-01-02'")
    assert sorted(r["v"] for r in cat.table("t").collect()) == [2, 3]
    cat.run("COMMENT ON COLUMN t.v IS 'it''s; a value'")
    assert cat.describe("t").collect()[1]["desc"] == "it's; a value"
    cat.run("DELETE FROM t")
    assert cat.table("t").count() == 0
    cat.run("DROP TABLE t")
    assert cat.tables().count() == 0


def test_key_value(cat):
    cat.sql("CREATE TABLE c (key TEXT, value TEXT) WITH (engine='kv'); INSERT INTO c (key, value) VALUES ('host', 'a'), ('port', '1'); INSERT INTO c (key, value) VALUES ('host', 'b')")
    assert [tuple(r) for r in cat.run("SELECT * FROM c").collect()] == [("host", "b"), ("port", "1")]
    cat.run("DELETE FROM c WHERE key = 'p*'")
    assert [tuple(r) for r in cat.run("SELECT * FROM c").collect()] == [("host", "b")]


@pytest.mark.parametrize("bad", ["CREATE TABLE x (a DOUBLE)", "CREATE TABLE x (ts NOTHING)", "SELECT * FROM nowhere", "SELECT * FROM t WHERE v = 1", "UPDATE t", "SELECT nope FROM t", "CREATE TABLE x (k INT, v TEXT) WITH (engine='kv')"])
def test_refused(cat, bad):
    cat.run("CREATE TABLE t (ts DATETIME, v DOUBLE)")
    with pytest.raises(StatementError):
        cat.run(bad).collect()
