"""The driver's tables as series."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import micros

S = "s AS (SELECT 'U' || lpad(user_id::VARCHAR, 6, '0') AS obj, ts, event_id AS seq, value AS price, event_type AS kind FROM events)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a series: a user is an object, the event's number its arrival."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("obj"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.col("event_type").alias("kind"))


def purchases(df: DataFrame) -> DataFrame:
    return df.filter("kind = 'purchase'").select("obj", "ts", "seq", F.col("price").alias("paid"))


def one_per_time(df: DataFrame) -> DataFrame:
    return purchases(df).groupBy("obj", "ts").agg(F.max("paid").alias("paid"))


def day() -> Column:
    """Blocks that windows over an object are sorted in."""
    return F.floor(micros("ts") / 86_400_000_000)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a temporary one in a local session without ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.gettempdir()).rstrip(os.sep)}/tidemark/{name}-{uuid.uuid4().hex}"
