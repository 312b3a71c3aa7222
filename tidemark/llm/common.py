"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table through the shared folder; Spark's cleaner removes it."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def batches_of(spark: SparkSession, n: int):
    """Rows that go to Python at once, for what runs inside: few where a row is megabytes."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, n)
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: column pruning, compression, no lineage."""
    path = _path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A stored table dealt into buckets by a key: joins on the key don't shuffle it again."""
    table = f"tidemark_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", _path(df.sparkSession, name)).bucketBy(min(buckets, 100_000), key).saveAsTable(table)
    return df.sparkSession.table(table)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for f in {f for t in tables for f in t.inputFiles()}:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/tidemark/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles of finished steps; else their files wait for the driver's next collection."""
    gc.collect()
    spark.range(1).count()  # so that nothing holds on to the last plan
    spark.sparkContext._jvm.System.gc()


_HOLDS: dict[str, Callable[[], None]] = {}
_last: str | None = None


def holds(operator: str, forget: Callable[[], None]) -> None:
    """Register how a worker forgets what an operator keeps from task to task."""
    _HOLDS[operator] = forget


def settle(operator: str) -> None:
    """When a task of an operator begins: what its worker holds of other operators goes back to the system."""
    global _last
    if _last not in (None, operator):
        for name, forget in _HOLDS.items():
            if name != operator:
                forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
    _last = operator


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column of the input can clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def each_text(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[list, list]]:
    """Ids and texts in lists of bounded size (about ``most`` bytes, one row at least)."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most / max(1, texts.nbytes)))
        for at in range(0, n, step):
            yield ids.slice(at, step).to_pylist(), texts.slice(at, step).to_pylist()


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


SPAN = "array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))


def find_spans(df: DataFrame, finder: Callable[[], Callable[[str], list[tuple]]]) -> DataFrame:
    """doc_id and the spans found in each text; ``finder`` builds the per-text function once in a worker."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", ARROW_SPAN)])
    names = ("kind", "start", "end", "base", "score")

    def run(batches):
        find = finder()
        for ids, texts in each_text(batches):
            yield rows(schema, ids, [[dict(zip(names, s, strict=True)) for s in find(t)] if t else [] for t in texts])

    return df.mapInArrow(run, f"doc_id long, spans {SPAN}")


def spelled(spans: Column | str) -> Column:
    """``kind:start:end`` of each span in its order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def base_digest() -> Column:
    return F.sha2(spelled(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256")
