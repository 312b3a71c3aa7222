"""The catalog from Python: queries, loading and joining tables, saving frames and files, verbs of a shell."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import shift
from ..functions.values import matches_any
from ..operators import joins
from ..operators.rows import fields_first
from ..sources import files
from .catalog import ADMIN, Catalog

# Statement types of Spark types.
SQL_TYPES = {"timestamp": "DateTime", "timestamp_ntz": "DateTime", "date": "DateTime", "double": "Double", "float": "F32", "bigint": "Int64", "int": "I32", "smallint": "I32", "tinyint": "I32", "boolean": "Boolean", "string": "String", "binary": "Bytes"}
#: From this many tables on a listing leaves out their columns.
MANY = 30


class Client:
    def __init__(self, spark: SparkSession, root: str, role: int = ADMIN, tz_offset: int = 0):
        self.catalog, self.role, self.tz_offset = Catalog(spark, root), role, tz_offset
        self.pool = ThreadPoolExecutor(4)

    def query(self, text: str) -> DataFrame | None:
        return self.catalog.run(text, self.role)

    def async_query(self, text: str) -> Future:
        return self.pool.submit(self.query, text)

    def set_time_zone(self, seconds: int) -> None:
        """Seconds east of UTC in which ``local`` shows times."""
        self.tz_offset = seconds

    def local(self, df: DataFrame) -> DataFrame:
        return df.select(*[shift(f.name, self.tz_offset).alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema])

    # tables -----------------------------------------------------------------------------------------------------------
    def tables(self) -> list[str]:
        return [r["name"] for r in self.catalog.tables().collect()]

    def table_schema(self, name: str) -> T.StructType | None:
        """The table's columns, None if there is none."""
        return self.catalog.table(name).schema if name in self.tables() else None

    def describe_tables(self) -> list[dict]:
        """Name, description and columns of each table; no columns where there are many tables."""
        metas = self.catalog._metas()
        return [{"name": m["name"], "desc": m["options"].get("desc")} | ({"columns": [{"name": f["name"], "type": f["type"], **f["metadata"]} for f in m["fields"]]} if len(metas) <= MANY else {}) for m in metas]

    def create_table(self, name: str, df: DataFrame, **options) -> None:
        """A table with the columns of a frame, times first."""
        shown = sorted((f for f in df.schema if f.name != "obj"), key=lambda f: f.name != "ts")
        if bad := [f.name for f in shown if f.dataType.simpleString() not in SQL_TYPES and not isinstance(f.dataType, T.DecimalType)]:
            raise ValueError(f"columns {bad} have no type here")
        kind = lambda f: f.dataType.simpleString() if isinstance(f.dataType, T.DecimalType) else SQL_TYPES[f.dataType.simpleString()]
        given = f" WITH ({', '.join(f'{k}={v!r}' for k, v in options.items())})" if options else ""
        self.query(f"CREATE TABLE {name} ({', '.join(f'`{f.name}` {kind(f)}' for f in shown)}){given}")

    # reading ------------------------------------------------------------------------------------------------------------
    def load(self, objs: str | list[str], tables: str | list[str], join: str | dict[str, str] | None = None, start=None, end=None, fields: dict[str, list[str]] | list[str] | None = None, hook: Callable[[str, DataFrame], DataFrame] | None = None):
        """Tables of some objects: a dict of frames, or with ``join`` one frame, joined left to right on object and time.
        The time window holds for the first table; a list of fields for every table."""
        names = [tables] if isinstance(tables, str) else tables
        own = lambda n: fields.get(n) if isinstance(fields, dict) else fields
        frames = {n: fields_first(self.catalog.table(n, lambda df: df.filter(matches_any("obj", objs))), own(n)) for n in names}
        if join is None:
            frames = {n: hook(n, d) if hook else d for n, d in frames.items()}
            first = frames[names[0]]
            for bound, test in ((start, first["ts"] >= F.lit(start).cast("timestamp_ntz")), (end, first["ts"] < F.lit(end).cast("timestamp_ntz"))):
                first = first.filter(test) if bound is not None else first
            return frames | {names[0]: first}
        return joins.load(frames, join, start, end, hook)

    def concat(self, df: DataFrame, base: str, join: str = "nan") -> DataFrame:
        return joins.align(df, base, join)

    def by_object(self, df: DataFrame) -> dict[str, DataFrame]:
        """A result's objects, each with its frame; names come to the driver, rows don't."""
        return {r["obj"]: df.filter(F.col("obj") == r["obj"]) for r in df.select("obj").distinct().orderBy("obj").collect()}

    # writing ------------------------------------------------------------------------------------------------------------
    def save(self, table: str, data: DataFrame | str | Iterable[tuple[str, object]], skip: int = 0) -> dict:
        """A frame with ``obj``, a CSV file, a folder of CSV files, or pairs of object and data; gives the import's figures."""
        began = time.time()
        if isinstance(data, DataFrame):
            rows = data
        elif isinstance(data, str):
            if Path(data).suffix not in ("", ".csv"):
                raise ValueError(f"unsupported file {data!r}")
            rows = self._lines(table, data, skip)
        else:
            frames = {n: files.from_memory(self.catalog.spark, n, d) for n, d in data}
            rows = None
            for d in frames.values():
                rows = d if rows is None else rows.unionByName(d)
        if rows is None:
            return {"total_rows": 0, "time_used_ms": 0, "rows_per_sec": 0}
        self.catalog.append(table, rows)
        return files.import_stats(rows, began, time.time())

    def _lines(self, table: str, path: str, skip: int) -> DataFrame:
        kind = [f for f in self.catalog.schema(self.catalog.meta(table)) if f.name not in ("obj", "_batch", "_seq")]
        return files.read_csv_body(self.catalog.spark, path, T.StructType(kind), skip)

    # shell ----------------------------------------------------------------------------------------------------------------
    def verb(self, line: str):
        """``.import table path [skip]``, ``.dump table path``, ``.schema table``, ``.rows table n``, ``.tables``, ``.help``."""
        m = re.match(r"\s*\.(\w+)\s*(.*?)\s*;?\s*$", line)
        name, args = (m[1], m[2].split()) if m else ("", [])
        if name == "import":
            return self.save(args[0], args[1], int(args[2]) if len(args) > 2 else 0)
        if name == "dump":
            return files.dump_csv(self.catalog.table(args[0]), args[1])
        if name == "schema":
            return self.catalog.describe(args[0])
        if name == "rows":
            return files.preview(self.catalog.table(args[0]), int(args[1]), ["ts"], F.col("ts").cast("date"))
        if name == "tables":
            return self.catalog.tables(*args[:1])
        if name == "help":
            return self.verb.__doc__
        raise ValueError(f"unknown verb {line!r}")
