"""Binary frames: a table of one object as Arrow bytes between a header and a checksum.

A frame is magic, version, size of what follows, table, checksum (CRC-32 of the table), little-endian. An object with very
many rows has several frames, each of ``size`` rows at most, so no task holds an object.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import chunked

# Fixed values of the format.
MAGIC, VERSION = 0x4D7C, 1
HEAD, FOOT = struct.Struct("<HHI"), struct.Struct("<I")


class FrameError(ValueError):
    pass


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    data = sink.getvalue().to_pybytes()
    return HEAD.pack(MAGIC, VERSION, len(data) + FOOT.size) + data + FOOT.pack(zlib.crc32(data))


def check(data: bytes) -> tuple[int, int]:
    """Sizes of header and rest of the frame that ``data`` begins with."""
    if len(data) < HEAD.size:
        raise FrameError(f"{len(data)} bytes are no frame")
    magic, version, size = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise FrameError("not a frame of this version")
    return HEAD.size, size


def unpack(data: bytes) -> pa.Table:
    head, size = check(data)
    if size < FOOT.size or len(data) < head + size:
        raise FrameError("the frame is cut off")
    body = data[head : head + size - FOOT.size]
    if FOOT.unpack_from(data, head + size - FOOT.size)[0] != zlib.crc32(body):
        raise FrameError("the checksum is wrong")
    return pa.ipc.open_stream(body).read_all()


def checksum(c: Column) -> Column:
    """CRC-32 of bytes or text."""
    return F.crc32(c.cast("binary"))


def to_frames(df: DataFrame, order: list[str], size: int = 100_000, block: Column | None = None) -> DataFrame:
    """obj, chunk and frame: the rows of each object, ``size`` to a frame."""
    fields = [c for c in df.columns if c != "obj"]
    at = chunked(df, size, order, ("obj",), block).drop("place")

    def run(group: pa.Table) -> pa.Table:
        own = group.select(fields).sort_by([(c, "ascending") for c in order])
        return pa.table({"obj": group.column("obj")[:1], "chunk": group.column("chunk")[:1], "frame": pa.array([pack(own)], pa.binary())})

    return at.groupBy("obj", "chunk").applyInArrow(run, "obj string, chunk long, frame binary")


def from_frames(frames: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """obj and the rows of all frames; one whose shape is another is refused, or left out unless ``strict``."""
    kind = T.StructType([T.StructField("obj", T.StringType()), *schema.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(kind)
        for b in batches:
            for obj, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    own = unpack(data)
                    if own.schema.names != want.names[1:]:
                        raise FrameError(f"columns {own.schema.names} instead of {want.names[1:]}")
                except FrameError:
                    if strict:
                        raise
                    continue
                got = pa.table([pa.array([obj] * own.num_rows, pa.string()), *(c.cast(f.type) for c, f in zip(own.columns, list(want)[1:], strict=True))], schema=want)
                yield from got.to_batches()

    return frames.select("obj", "frame").mapInArrow(run, kind)


def each_frame(frames: DataFrame) -> Iterator[tuple[str, pa.Table]]:
    """Objects and their tables, one frame at a time on the driver."""
    for r in frames.select("obj", "frame").toLocalIterator():
        yield r["obj"], unpack(bytes(r["frame"]))


def empty(spark: SparkSession, text: str) -> DataFrame:
    """A frame without rows from a schema as JSON, either Spark's or a list of columns with name and kind."""
    import json

    got = json.loads(text)
    if "fields" in got:
        return spark.createDataFrame([], T.StructType.fromJson(got))
    kinds = {k.lower(): v for k, v in KINDS.items()}
    columns = got.get("columns", [])
    if bad := [c for c in columns if not c.get("name") or str(c.get("kind", "")).lower() not in kinds]:
        raise ValueError(f"columns without a name or a known kind: {bad}")
    return spark.createDataFrame([], ", ".join(f"`{c['name']}` {kinds[str(c['kind']).lower()]}" for c in columns))


# Names of kinds in a schema.
KINDS = {"DateTime": "timestamp_ntz", "Float64": "double", "Float32": "float", "Int64": "bigint", "Int32": "int", "Int16": "smallint", "Int8": "tinyint", "UInt64": "decimal(20,0)", "UInt32": "bigint", "UInt16": "int", "UInt8": "smallint", "String": "string", "Boolean": "boolean", "Bool": "boolean", "Bytes": "binary", "Decimal64": "decimal(17,6)", "Decimal128": "decimal(38,10)"}
