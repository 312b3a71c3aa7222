"""CSV, Parquet and in-memory sources and sinks of series tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import parsed
from ..functions.time import format_ts
from ..operators.rows import chunked, numbered


REJECT = "_rejected"


def parsed_lines(lines: DataFrame, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Lines (``value``) whose first field is the object, typed; ``_rejected`` holds a line that doesn't fit, else null."""
    kind = T.StructType([T.StructField("obj", T.StringType()), *[T.StructField(f.name, T.StringType()) for f in schema.fields]])
    text = F.from_csv("value", ddl(kind) + f", `{REJECT}` string", {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT})
    got = lines.filter(F.trim("value") != "").select("value", text.alias("r"))
    typed = [(f, parsed(F.col("r").getField(f.name), f.dataType)) for f in schema.fields]
    wrong = F.col("r").getField(REJECT).isNotNull() | (F.size(F.split("value", re.escape(sep), -1)) < len(schema.fields) + 1)
    for f, c in typed:
        wrong = wrong | ((F.trim(F.col("r").getField(f.name)) != "") & c.isNull())
    wrong = F.coalesce(wrong, F.lit(False))
    return got.select(F.col("r.obj").alias("obj"), *[c.alias(f.name) for f, c in typed], F.when(wrong, F.col("value")).alias(REJECT))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that were rejected (``line``)."""
    return df.filter(F.col(REJECT).isNull()).drop(REJECT), df.filter(F.col(REJECT).isNotNull()).select(F.col(REJECT).alias("line"))


def read_csv_body(spark: SparkSession, path: str, schema: T.StructType, skip: int = 0, sep: str = ",", rejects: str | None = None) -> DataFrame:
    """Headerless CSV whose first column is the object; ``skip`` leaves out that many lines of each file, blank ones too.

    A line that doesn't fit stops the reading; with a path in ``rejects`` such lines are written there instead.
    """
    lines = spark.read.text(path)
    if skip:
        # positions within a file: only its own first split can hold them
        lines = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        n = F.row_number().over(Window.partitionBy("f").orderBy("i"))
        first = lines.filter("b = 0").withColumn("n", n).filter(F.col("n") <= skip).select("i")
        lines = lines.join(F.broadcast(first), "i", "left_anti").select("value")
    got = parsed_lines(lines, schema, sep)
    if rejects is None:
        # in every column and not as a filter, which would be tested before skipped lines are gone
        stop = F.raise_error(F.concat(F.lit("not a row: "), F.col(REJECT)))
        return got.select(*[F.when(F.col(REJECT).isNotNull(), stop.cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in got.schema if f.name != REJECT])
    good, bad = split_rejects(got)
    bad.write.mode("overwrite").text(rejects)
    return good


def rows_of_lines(lines: list[str], sep: str = ",", skip_col: int = 0) -> list[list[str]]:
    """Fields of lines as text, without the first ``skip_col`` of them; blank lines are left out."""
    import csv

    return [r[skip_col:] for r in csv.reader([x for x in lines if x.strip()], delimiter=sep)]


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", rejects: str | None = None) -> DataFrame:
    """CSV with a header that must fit the schema; rows that don't parse go to ``rejects``, without it they stop the reading."""
    if rejects is None:
        return spark.read.csv(path, schema=schema, header=True, sep=sep, enforceSchema=False, mode="FAILFAST")
    whole = T.StructType([*schema.fields, T.StructField(REJECT, T.StringType())])
    got = spark.read.csv(path, schema=whole, header=True, sep=sep, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECT).cache()
    head = spark.read.text(path).first()
    if head is not None and [h.strip() for h in head[0].split(sep)] != schema.names:
        raise ValueError(f"header {head[0]!r} instead of {schema.names}")
    good, bad = split_rejects(got)
    bad.write.mode("overwrite").text(rejects)
    return good


def read_excel(spark: SparkSession, path: str, schema: T.StructType, by_sheet: bool = True) -> DataFrame:
    """A workbook: each sheet is an object, or the first column names it. Needs pandas with an Excel engine."""
    import pandas as pd

    sheets = pd.read_excel(path, sheet_name=None)
    if by_sheet:
        frames = [d.assign(obj=n) for n, d in sheets.items()]
    else:
        frames = [d.rename(columns={d.columns[0]: "obj"}) for d in sheets.values()]
    kind = T.StructType([T.StructField("obj", T.StringType()), *schema.fields])
    return spark.createDataFrame(pd.concat(frames)[kind.names].astype({"obj": str}), kind)


def import_stats(df: DataFrame, began: float, ended: float) -> dict:
    """Rows of an import, its milliseconds and rows a second."""
    n, took = df.count(), max(ended - began, 1e-9)
    return {"total_rows": n, "time_used_ms": int(took * 1000), "rows_per_sec": round(n / took)}


def from_memory(spark: SparkSession, obj: str, data, schema: T.StructType | None = None) -> DataFrame:
    """A pandas or polars frame, an Arrow table, or a list of (name, values), as rows of one object."""
    if isinstance(data, list):
        import pandas as pd

        data = pd.DataFrame(dict(data))
    elif hasattr(data, "to_arrow"):
        data = data.to_arrow()
    df = spark.createDataFrame(data, schema)
    return df.select(F.lit(obj).alias("obj"), *df.columns)


def write_series(df: DataFrame, path: str, chunk: int = 1_000_000, mode: str = "overwrite") -> None:
    """Parquet, ranged and sorted by (obj, ts), so that row-group statistics prune scans; a large object spans files."""
    df.repartitionByRange("obj", "ts").sortWithinPartitions("obj", "ts").write.option("maxRecordsPerFile", chunk).mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", tz_offset: int = 0) -> None:
    shown = [format_ts(f.name, tz_offset).alias(f.name) if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)) else F.col(f.name) for f in df.schema]
    df.select(*shown).write.mode("overwrite").csv(path, header=header, sep=sep)


def dump_csv(df: DataFrame, path: str, sep: str = ",", tz_offset: int = 0) -> None:
    """Headerless CSV with the object in front, as ``read_csv_body`` takes it."""
    write_csv(df.select("obj", *[c for c in df.columns if c != "obj"]), path, header=False, sep=sep, tz_offset=tz_offset)


def to_ndjson(df: DataFrame, order: list[str], size: int = 10_000, block: Column | None = None) -> DataFrame:
    """A JSON table for each object (for each ``size`` rows of it): obj, chunk and ``line`` with the columns as arrays."""
    fields = [c for c in df.columns if c != "obj"]
    at = chunked(df, size, order, ("obj",), block)
    rows = F.array_sort(F.collect_list(F.struct("place", *fields)))  # size rows at most
    packed = at.groupBy("obj", "chunk").agg(rows.alias("r"))
    columns = F.struct(F.col("obj"), *[F.col(f"r.{c}").alias(c) for c in fields])
    return packed.select("obj", "chunk", F.to_json(columns, {"ignoreNullFields": "false"}).alias("line"))


def preview(df: DataFrame, rows: int, order: list[str], block: Column | None = None) -> DataFrame:
    """The upper and lower halves of ``rows`` rows of each object, numbered from 1."""
    up = numbered(df, order, ("obj",), "_up", block)
    many = up.groupBy("obj").agg(F.count("*").alias("_many")).withColumnRenamed("obj", "_o")
    got = up.join(many, F.col("obj").eqNullSafe(F.col("_o")))
    return got.filter((F.col("_up") < rows // 2) | (F.col("_up") >= F.col("_many") - (rows - rows // 2))).select((F.col("_up") + 1).alias("no"), *df.columns)


def to_arrays(df: DataFrame) -> dict:
    """Columns as numpy arrays, on the driver."""
    return {c: df_.to_numpy() for c, df_ in df.toPandas().items()}


class Rows:
    """A table on the driver, by cell, row and column."""

    def __init__(self, df: DataFrame):
        self.names, self.rows = df.columns, [tuple(r) for r in df.collect()]

    def cell(self, row: int, column: str | int):
        return self.rows[row][column if isinstance(column, int) else self.names.index(column)]

    def column(self, column: str | int) -> list:
        return [self.cell(k, column) for k in range(len(self.rows))]

    def __iter__(self):
        return (dict(zip(self.names, r, strict=True)) for r in self.rows)

    def __len__(self) -> int:
        return len(self.rows)
