"""A catalog of series and key-value tables, kept as Parquet with a JSON description beside it, and its statements.

Statements: CREATE TABLE, DROP TABLE, COMMENT ON, INSERT ... VALUES, COPY, SELECT, DELETE, DESC, .tables; several by ``;``.

A table's description names the folders that hold it and has a version; a write makes new folders and then the description's
next version, so a reader sees the table before or after a write, a crash leaves the old version, and of two writers of one
version the second fails. A table with ``round`` is rolled up as rows come in: buckets that newer ones have closed are stored
as they are read, rows of each object's newest bucket stay raw in a small folder, late rows are dropped. A table with
``chan`` hands each new row on to its targets, changed values against the object's row before, and so on along the chain; what
is to be handed on is part of the source's version and what came is part of the target's, so a crash between loses or doubles none.
Folders that queries read are ranged and sorted by object and time, so bounds on them prune files and row groups.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import parsed
from ..functions.time import parse_datetime, parse_unit, round_ts
from ..functions.values import matches_any
from ..operators import chain, kv
from ..operators.rollup import rollup
from ..operators.scan import list_objects, ordered, scan
from ..operators.sets import without

# Type names and aggregate keywords.
TYPES = {"datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "date": "timestamp_ntz", "time": "timestamp_ntz", "double": "double", "f64": "double", "float64": "double", "float": "float", "f32": "float", "single": "float", "int": "bigint", "bigint": "bigint", "int64": "bigint", "i64": "bigint", "int32": "int", "i32": "int", "uint32": "bigint", "u32": "bigint", "uint64": "decimal(20,0)", "u64": "decimal(20,0)", "bool": "boolean", "boolean": "boolean", "d64": "decimal(17,6)", "d128": "decimal(38,10)", "string": "string", "text": "string", "varchar": "string", "char": "string", "bytes": "binary", "binary": "binary"}
AGGS = {"AGG_FIRST": "first", "AGG_MIN": "min", "AGG_MAX": "max", "AGG_SUM": "sum", "AGG_COUNT": "count", "AGG_AVG": "avg", "AGG_UNIQ_COUNT": "uniq_count", "AGG_DIFF_FIRST": "diff_first", "AGG_DIFF_PREV": "diff_prev", "AGG_DIFF_LAST": "diff_prev"}
TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|([`\"\[][^`\"\]]+[`\"\]])|(-?\d+(?:\.\d+)?(?![\w-]))|([.\w]+)|(>=|<=|<>|!=|[(),=<>*;]))")


class StatementError(ValueError):
    pass


class Tokens:
    def __init__(self, text: str):
        self.all, self.k, at = [], 0, 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise StatementError(f"can't read {text[at:at + 20]!r}")
            at = m.end()
            s, quoted, number, word, sign = m.groups()
            self.all.append(("text", s[1:-1].replace("''", "'")) if s else ("name", quoted[1:-1]) if quoted else ("number", number) if number else ("name", word) if word else ("sign", sign))

    def peek(self, *words: str) -> bool:
        return self.k < len(self.all) and self.all[self.k][0] != "text" and self.all[self.k][1].upper() in words

    def take(self, *words: str) -> bool:
        got = self.peek(*words)
        self.k += got
        return got

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise StatementError(f"expected {' or '.join(words)}")

    def next(self, *kinds: str) -> str:
        if self.k >= len(self.all) or kinds and self.all[self.k][0] not in kinds:
            raise StatementError(f"expected {' or '.join(kinds) or 'more'}")
        self.k += 1
        return self.all[self.k - 1][1]

    @property
    def over(self) -> bool:
        return self.k >= len(self.all)

    def end(self) -> None:
        if not self.over:
            raise StatementError(f"unexpected {self.all[self.k][1]!r}")


#: What a caller may do, and what each statement needs; an admin may do everything.
READ, WRITE, ADMIN = 1, 2, 7
NEEDS = {"SELECT": READ, "DESC": READ, "DESCRIBE": READ, ".TABLES": READ, "INSERT": WRITE, "COPY": WRITE, "DELETE": 4, "CREATE": 4, "DROP": 4, "COMMENT": 4}


def kind_of(text: str) -> str:
    """The kind of a statement, by its first word."""
    m = re.match(r"\s*(\.tables|\\dt|\w+)", text, re.I)
    word = m[1].upper() if m else ""
    word = ".TABLES" if word == "\\DT" else word
    if word not in NEEDS:
        raise StatementError(f"unknown statement {word or text[:20]!r}")
    return word


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # tables -----------------------------------------------------------------------------------------------------------
    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _metas(self) -> list[dict]:
        """The newest description of every table."""
        fs, path = self._path("schema")
        if not fs.exists(path):
            return []
        files = self.spark.read.text(f"{self.root}/schema", recursiveFileLookup=True, wholetext=True)
        newest: dict[str, dict] = {}
        for r in files.collect():
            m = json.loads(r["value"])
            if m["version"] >= newest.get(m["name"], {"version": -1})["version"]:
                newest[m["name"]] = m
        return sorted((m for m in newest.values() if not m.get("dropped")), key=lambda m: m["name"])

    def meta(self, name: str) -> dict:
        for m in self._metas():
            if m["name"] == name:
                return m
        raise StatementError(f"no table {name!r}")

    def _keep(self, meta: dict) -> None:
        """Write the next version; it fails if another writer was faster."""
        meta = meta | {"version": meta["version"] + 1}
        fs, path = self._path("schema", meta["name"], f"{meta['version']:012d}.json")
        fs.mkdirs(path.getParent())
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        old = self._path("schema", meta["name"], f"{meta['version'] - 3:012d}.json")[1]
        if fs.exists(old):
            fs.delete(old, False)

    def schema(self, meta: dict) -> T.StructType:
        lead = [] if meta["kv"] else [T.StructField("obj", T.StringType())]
        arrival = [T.StructField("_batch", T.LongType()), T.StructField("_seq", T.LongType())]
        return T.StructType([*lead, *T.StructType.fromJson({"type": "struct", "fields": meta["fields"]}).fields, *arrival])

    def create(self, name: str, fields: list[tuple[str, str, dict]], options: dict) -> None:
        """Make a table; one that exists stays as it is."""
        known = {m["name"]: m for m in self._metas()}
        if name in known:
            return
        is_kv = str(options.get("engine", "")).lower() == "kv"
        if is_kv and (len(fields) != 2 or any(k not in ("string", "binary") for _, k, _ in fields)):
            raise StatementError("a key-value table has two columns of text or bytes")
        if not is_kv and (not fields or fields[0][1] != "timestamp_ntz"):
            raise StatementError("the first column must be a datetime")
        if options.get("round"):
            parse_unit(options["round"])
        if "chunkSize" in options and float(options["chunkSize"]) < 1:
            raise StatementError("chunkSize must be positive")
        if options.get("chan"):
            rule = chain.parse_rule(options["chan"])
            if missing := [t for t in rule.targets if t not in known]:
                raise StatementError(f"chain targets {missing} don't exist")
            shapes = [[(f["name"], f["type"]) for f in known[t]["fields"]] for t in rule.targets]
            if any(x != shapes[0] for x in shapes) or len(rule.items) != len(shapes[0]) - 1:
                raise StatementError("chain targets need one shape and a column for each item")
            chain.cascade_order({m["name"]: chain.parse_rule(m["options"]["chan"]) for m in known.values() if m["options"].get("chan")} | {name: rule})
        kinds = T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k, _ in fields))
        fs, path = self._path("schema", name)
        last = max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path)), default=0) if fs.exists(path) else 0
        self._keep({"name": name, "version": last, "kv": is_kv, "options": options, "fields": [f.jsonValue() | {"metadata": m} for f, (_, _, m) in zip(kinds, fields, strict=True)], "parts": [], "open": None, "last": None})

    def drop(self, name: str) -> None:
        m = self.meta(name)
        self._keep(m | {"dropped": True, "parts": [], "open": None, "last": None})
        fs, path = self._path("data", name)
        fs.delete(path, True)

    def describe(self, name: str) -> DataFrame:
        m = self.meta(name)
        rows = [(f["name"], T.StructType.fromJson({"type": "struct", "fields": [f]})[0].dataType.simpleString(), f["metadata"].get("agg"), f["metadata"].get("desc")) for f in m["fields"]]
        return self.spark.createDataFrame(rows, "name string, type string, agg string, desc string")

    def tables(self, pattern: str = "") -> DataFrame:
        rows = [(m["name"], json.dumps(m["fields"])) for m in self._metas()]
        return self.spark.createDataFrame(rows, "name string, schema string").filter(matches_any("name", pattern)).orderBy("name")

    def _read(self, meta: dict, folders: list[str], schema: T.StructType | None = None) -> DataFrame:
        schema = schema or self.schema(meta)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _write(self, meta: dict, rows: DataFrame, ranged: bool = True) -> str:
        """Rows in a new folder, ranged and sorted by object and time, ``chunkSize`` rows to a file from a thousand chunks on;
        without ``ranged``, for what is only read whole, as they come."""
        folder = f"{meta['name']}/{meta['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        if ranged and not meta["kv"]:
            ts = meta["fields"][0]["name"]
            rows = rows.repartitionByRange("obj", ts).sortWithinPartitions("obj", ts)
        most = int(float(meta["options"].get("chunkSize", 200)) * 1000)
        rows.write.option("maxRecordsPerFile", most).parquet(f"{self.root}/data/{folder}")
        return folder

    def raw(self, name: str) -> DataFrame:
        """Rows as they are kept: of a table with ``round`` the closed buckets."""
        m = self.meta(name)
        return self._read(m, m["parts"])

    def _aggs(self, meta: dict) -> dict[str, str]:
        return {f["name"]: f["metadata"].get("agg", "latest") for f in meta["fields"][1:]}

    def _rolled(self, meta: dict, rows: DataFrame) -> DataFrame:
        """Rows of one or more buckets as the table shows them."""
        ts, whole = meta["fields"][0]["name"], self.schema(meta)
        got = rollup(rows.withColumn("_at", F.struct("_batch", "_seq")).withColumnRenamed(ts, "ts"), meta["options"]["round"], self._aggs(meta), seq="_at")
        kinds = {f.name: f.dataType for f in whole}
        return got.withColumnRenamed("ts", ts).select(*[F.col(f.name).cast(kinds[f.name]).alias(f.name) if f.name not in ("_batch", "_seq") else F.lit(None).cast("long").alias(f.name) for f in whole])

    def table(self, name: str, where=lambda df: df) -> DataFrame:
        """Rows as queries see them: rolled up by the table's ``round``, or the last write of each key; ``where`` goes to the
        stored rows, where it can prune, and to the open buckets."""
        m = self.meta(name)
        stored = self._read(m, m["parts"])
        if m["kv"]:
            key, value = (f["name"] for f in m["fields"])
            last = kv.current(stored.select(F.col(key).alias("key"), F.col(value).alias("value"), F.struct("_batch", "_seq").alias("seq")))
            return where(last.withColumnsRenamed({"key": key, "value": value}))
        got = where(stored)
        if m["options"].get("round") and m["open"]:
            got = got.unionByName(where(self._rolled(m, self._read(m, [m["open"]]))))
        return got.drop("_batch", "_seq")

    def append(self, name: str, rows: DataFrame, taken: tuple[str, str] | None = None, seq: str | None = None) -> None:
        """Add rows, which arrive in the order they are in, or in that of the whole numbers in ``seq``, which needs no sort;
        ``taken`` names the source and the folder of rows a chain hands on."""
        m = self.meta(name)
        if m.get("pending"):
            self.hand_on(name)
            m = self.meta(name)
        if taken is not None:
            m["taken"] = m.get("taken", {}) | dict([taken])
        whole, ts = self.schema(m), m["fields"][0]["name"]
        shown = [F.col(f.name).cast(f.dataType).alias(f.name) for f in whole if f.name not in ("_batch", "_seq")]
        arrival = F.monotonically_increasing_id() if seq is None else F.col(seq).cast("long")
        new = rows.select(*shown, F.lit(m["version"] + 1).cast("long").alias("_batch"), arrival.alias("_seq"))
        if m["kv"]:
            return self._keep(m | {"parts": [*m["parts"], self._write(m, new)]})
        work = []  # folders of this write alone

        def once(df: DataFrame) -> DataFrame:
            """What follows reads these rows several times."""
            work.append(self._write(m | {"name": f"{name}-work"}, df, False))
            return self._read(m, work[-1:], df.schema)

        if not m["options"].get("round"):
            fresh = self._write(m, new)
            after, added = m | {"parts": [*m["parts"], fresh]}, self._read(m, [fresh])
        else:
            bucket = round_ts(ts, m["options"]["round"], int(m["options"].get("tz", 0)))
            new = new if taken else once(new)  # a chain's rows are in a folder already
            both = self._read(m, [m["open"]] if m["open"] else []).withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True))).withColumn("_bucket", bucket)
            tops = both.groupBy(F.col("obj").alias("_obj")).agg(F.max(F.when(~F.col("_new"), F.col("_bucket"))).alias("_open"), F.max("_bucket").alias("_top"))
            every = once(both.join(tops, F.col("obj").eqNullSafe(F.col("_obj"))).filter("_open IS NULL OR _bucket >= _open").drop("_obj"))
            closed, still = every.filter("_bucket < _top").select(*whole.names), every.filter("_bucket = _top").select(*whole.names)
            after = m | {"parts": [*m["parts"], self._write(m, self._rolled(m, closed))], "open": self._write(m, still)}
            if m["options"].get("chan"):  # only rows that open a bucket are handed on
                opening = every.filter("_new AND (_open IS NULL OR _bucket > _open)")
                first = opening.groupBy("obj", "_bucket").agg(F.min_by(F.struct(*whole.names), F.struct(ts, "_seq")).alias("r"))
                added = once(first.select("r.*", "_bucket").withColumn(ts, F.col("_bucket")).select(*whole.names))
        if m["options"].get("chan"):
            rule = chain.parse_rule(m["options"]["chan"])
            last = self._read(m, [m["last"]] if m["last"] else [])
            named = lambda df: df.withColumnRenamed(ts, "ts")
            targets = [self.meta(t) for t in rule.targets]  # all of them, before anything is written
            columns = [f["name"] for f in targets[0]["fields"][1:]]
            passed = chain.project(named(added), rule, columns, ["ts", "_batch", "_seq"], last=named(last)).withColumnRenamed("ts", ts)
            ends = last.unionByName(added).groupBy("obj").agg(F.max_by(F.struct(*whole.names), F.struct(ts, "_batch", "_seq")).alias("r")).select("r.*")
            handed = self._write(m | {"name": f"{name}-chain"}, passed, False)
            after = after | {"last": self._write(m, ends, False), "pending": {"folder": handed, "schema": passed.schema.jsonValue()}}
        self._keep(after)
        for folder in work:
            fs, path = self._path("data", folder)
            fs.delete(path, True)
        if m["options"].get("chan"):
            self.hand_on(name)

    def hand_on(self, name: str) -> None:
        """Give a chain's targets the rows its source's last write left for them, each target once, also after a crash."""
        m = self.meta(name)
        if not (left := m.get("pending")):
            return
        ts = m["fields"][0]["name"]
        for t in chain.parse_rule(m["options"]["chan"]).targets:
            target = self.meta(t)
            if target.get("taken", {}).get(name) != left["folder"]:
                rows = self._read(m, [left["folder"]], T.StructType.fromJson(left["schema"])).withColumnRenamed(ts, target["fields"][0]["name"])
                if target["kv"]:  # by arrival alone
                    self.append(t, rows.orderBy("obj", target["fields"][0]["name"], "_batch", "_seq"), (name, left["folder"]))
                else:  # by time first, and these are of one batch
                    self.append(t, rows, (name, left["folder"]), "_seq")
            else:
                self.hand_on(t)
        self._keep(self.meta(name) | {"pending": None})

    def recover(self) -> None:
        """After a crash: finish what chains have left to hand on. A write does the same for its own table."""
        for m in self._metas():
            self.hand_on(m["name"])

    def replace(self, name: str, parts: DataFrame, open_: DataFrame | None = None) -> None:
        """The table's rows, and those of its open buckets, are these from now on."""
        m = self.meta(name)
        self._keep(m | {"parts": [self._write(m, parts)], "open": self._write(m, open_) if open_ is not None else None})

    def compact(self, name: str) -> None:
        """Many small folders become one."""
        m = self.meta(name)
        if len(m["parts"]) > 1:
            self._keep(m | {"parts": [self._write(m, self._read(m, m["parts"]))]})

    def set_option(self, name: str, key: str, value, column: str | None = None) -> None:
        """Metadata of a table or a column."""
        m = self.meta(name)
        if column is None:
            m["options"][key] = value
        else:
            found = [f for f in m["fields"] if f["name"].lower() == column.lower()]
            if not found:
                raise StatementError(f"no column {column!r} in {name!r}")
            found[0]["metadata"][key] = value
        self._keep(m)

    # statements -------------------------------------------------------------------------------------------------------
    def sql(self, text: str) -> list[DataFrame | None]:
        """Run statements one after another; queries give a DataFrame, the others None."""
        out: list[DataFrame | None] = []
        while text.strip():
            if re.match(r"\s*COPY\b", text, re.I):  # its lines end at an empty one
                part, _, text = text.partition("\n\n")
            else:
                part = re.match(r"(?:[^;']|'(?:[^']|'')*')*", text)[0]
                text = text[len(part) + 1 :]
            if part.strip():
                out.append(self.run(part))
        return out

    def run(self, text: str, role: int = ADMIN) -> DataFrame | None:
        """One statement; ``role`` is the sum of what the caller may do."""
        word = kind_of(text)
        if not role & NEEDS[word]:
            raise PermissionError(f"{word} needs another role")
        if word == ".TABLES":
            rest = re.sub(r"^\s*(\.tables|\\dt)", "", text, flags=re.I).strip().rstrip(";").strip().strip("'\"")
            return self.tables(rest)
        if word == "COPY":
            return self.copy(text)
        t = Tokens(text)
        t.next("name")
        return getattr(self, f"_{ {'DESCRIBE': 'desc'}.get(word, word.lower()) }")(t)

    def _create(self, t: Tokens) -> None:
        t.need("TABLE")
        if t.take("IF"):
            t.need("NOT"), t.need("EXISTS")
        name, fields, options = t.next("name"), [], {}
        t.need("(")
        while True:
            column, kind, notes = t.next("name"), t.next("name"), {}
            if t.take("("):
                kind += "(" + t.next("number") + ("," + t.next("number") if t.take(",") else "") + ")"
                t.need(")")
            while not t.peek(",", ")"):
                if t.take("COMMENT"):
                    notes["desc"] = t.next("text")
                elif (w := t.next("name").upper()) in AGGS:
                    notes["agg"] = AGGS[w]
                else:
                    raise StatementError(f"unknown column option {w}")
            own = TYPES.get(kind.lower().split("(")[0]) if "(" not in kind or kind.lower().startswith(("varchar", "char")) else kind.lower()
            if own is None:
                raise StatementError(f"unknown type {kind}")
            fields.append((column, own, notes))
            if not t.take(","):
                break
        t.need(")")
        if t.take("COMMENT"):
            options["desc"] = t.next("text")
        if t.take("WITH"):
            t.need("(")
            while True:
                key = t.next("name")
                t.need("=")
                options[key] = t.next()
                if not t.take(","):
                    break
            t.need(")")
        t.end()
        self.create(name, fields, options)

    def _drop(self, t: Tokens) -> None:
        t.need("TABLE")
        self.drop(t.next("name"))
        t.end()

    def _desc(self, t: Tokens) -> DataFrame:
        name = t.next("name")
        t.end()
        return self.describe(name)

    def _comment(self, t: Tokens) -> None:
        t.need("ON")
        column = t.take("COLUMN")
        if not column:
            t.need("TABLE")
        name = t.next("name")
        t.need("IS")
        text = t.next("text")
        t.end()
        name, _, field = name.partition(".")
        self.set_option(name, "desc", text, field if column else None)

    def copy(self, text: str) -> None:
        """``COPY table [HEADER]`` and lines of CSV, object first; with HEADER the first line names the columns."""
        from ..sources.files import parsed_lines, split_rejects

        first, _, body = text.strip().partition("\n")
        m = re.fullmatch(r"COPY\s+[`\"\[]?(\w+)[`\"\]]?(\s+(?:WITH\s+)?HEADER)?\s*;?", first.strip(), re.I)
        if not m:
            raise StatementError(f"not a COPY statement: {first!r}")
        meta, lines = self.meta(m[1]), [x for x in body.splitlines() if x.strip()]
        whole = [f for f in self.schema(meta) if f.name not in ("obj", "_batch", "_seq")]
        if meta["kv"]:
            raise StatementError("COPY is for series")
        if m[2]:
            known = {f.name.lower(): f for f in whole}
            names = [x.strip().lower() for x in lines[0].split(",")] if lines else []
            if names[:1] != ["obj"] or any(x not in known for x in names[1:]):
                raise StatementError(f"header {names} doesn't fit {m[1]!r}")
            whole, lines = [known[x] for x in names[1:]], lines[1:]
        got = parsed_lines(self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), T.StructType(whole))
        good, bad = split_rejects(got)
        if wrong := bad.limit(1).collect():
            raise StatementError(f"not a row of {m[1]!r}: {wrong[0]['line']!r}")
        missing = [f for f in self.schema(meta) if f.name not in (*good.columns, "_batch", "_seq")]
        self.append(m[1], good.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]))

    def _insert(self, t: Tokens) -> None:
        t.need("INTO")
        name = t.next("name")
        m = self.meta(name)
        names = [f.name for f in self.schema(m) if f.name not in ("_batch", "_seq")]
        if t.take("("):
            names = [t.next("name")]
            while t.take(","):
                names.append(t.next("name"))
            t.need(")")
        t.need("VALUES")
        rows = []
        while True:
            t.need("(")
            row = [None if t.take("NULL") else t.next()]
            while t.take(","):
                row.append(None if t.take("NULL") else t.next())
            t.need(")")
            if len(row) != len(names):
                raise StatementError(f"{len(row)} values for {len(names)} columns")
            rows.append(row)
            if not t.take(","):
                break
        t.end()
        given = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)).coalesce(1)
        kinds = {f.name: f.dataType for f in self.schema(m)}
        if unknown := [n for n in names if n not in kinds or n in ("_batch", "_seq")]:
            raise StatementError(f"unknown columns {unknown}")
        made = {n: F.lit(None).cast(kinds[n]) if n not in names else parsed(F.col(n), kinds[n]) for n in kinds if n not in ("_batch", "_seq")}
        wrong = reduce(lambda a, b: a | b, [F.col(n).isNotNull() & (F.trim(n) != "") & made[n].isNull() for n in names])
        if bad := given.filter(wrong).limit(1).collect():
            raise StatementError(f"not a row of {name!r}: {tuple(bad[0])}")
        self.append(name, given.select(*[c.alias(n) for n, c in made.items()]))

    def _where(self, t: Tokens, key: str) -> dict:
        """Conditions on obj (or the key) and ts; anything else is refused."""
        got: dict = {}
        if not t.take("WHERE"):
            return got
        flip = {">": "<", "<": ">", ">=": "<=", "<=": ">=", "=": "="}
        while True:
            value = t.next("text", "number") if t.all[t.k][0] in ("text", "number") else None
            sign = t.next("sign") if value is not None else None
            column = t.next("name").lower()
            if value is None and t.take("BETWEEN"):
                low = t.next("text", "number")
                t.need("AND")
                found = [(">=", low), ("<=", t.next("text", "number"))]
            elif value is None and (negated := t.take("NOT") or False, t.take("IN"))[1]:
                t.need("(")
                many = [t.next("text")]
                while t.take(","):
                    many.append(t.next("text"))
                t.need(")")
                found = [("not in" if negated else "in", many)]
            else:
                found = [(flip[sign], value)] if value is not None else [(t.next("sign"), t.next("text", "number"))]
            for sign, value in found:
                if column == key and sign in ("=", "in", "not in"):
                    got.setdefault("not" if sign == "not in" else "obj", []).extend(value if isinstance(value, list) else [value])
                elif column == "ts" and sign in flip:
                    got.setdefault("ts", []).append((sign, value))
                else:
                    raise StatementError(f"can't filter {column} by {sign}")
            if not t.take("AND"):
                return got

    def _filtered(self, df: DataFrame, where: dict, key: str, negate: bool = False, time: str = "ts") -> DataFrame:
        hit = F.lit(True)
        if where.get("obj"):
            hit &= matches_any(key, where["obj"])
        if where.get("not"):
            hit &= ~matches_any(key, where["not"])
        for sign, value in where.get("ts", ()):
            at, ts = parse_datetime(F.lit(value)), F.col(time)
            hit &= {">": ts > at, ">=": ts >= at, "<": ts < at, "<=": ts <= at, "=": ts == at}[sign]
        return df.filter(~F.coalesce(hit, F.lit(False)) if negate else hit)

    def _select(self, t: Tokens) -> DataFrame:
        shown: list[tuple[str, str]] | None = []
        while True:
            if t.take("*"):
                shown = None
            else:
                c = t.next("name")
                alias = t.next("name") if t.take("AS") else c
                shown = shown if shown is None else [*shown, (c, alias)]
            if not t.take(","):
                break
        t.need("FROM")
        name = t.next("name")
        m = self.meta(name)
        key = m["fields"][0]["name"].lower() if m["kv"] else "obj"
        where, desc, limit, offset = self._where(t, key), False, None, 0
        if t.take("ORDER"):
            t.need("BY")
            t.next("name")
            desc = t.take("DESC") or t.take("ASC") and False
        if t.take("LIMIT"):
            limit = int(t.next("number"))
        if t.take("OFFSET"):
            offset = int(t.next("number"))
        t.end()
        df = self.table(name, lambda df: self._filtered(df, where, key, time=m["fields"][0]["name"]))
        if not m["kv"]:
            df = df.withColumnRenamed(m["fields"][0]["name"], "ts")
        if m["kv"]:
            return df.orderBy(m["fields"][0]["name"])
        if shown == [("obj", "obj")]:
            return list_objects(df).orderBy("obj")
        names = {c.lower(): c for c in df.columns}
        if shown and (bad := [c for c, _ in shown if c.lower() not in names]):
            raise StatementError(f"unknown columns {bad}")
        got = scan(df, columns=None if shown is None else [c for c, _ in shown], desc=desc, limit_per_obj=limit, offset=offset)
        return ordered(got, desc).withColumnsRenamed({names[c.lower()]: a for c, a in shown or ()})

    def _delete(self, t: Tokens) -> None:
        t.need("FROM")
        name = t.next("name")
        m = self.meta(name)
        key = m["fields"][0]["name"].lower() if m["kv"] else "obj"
        where = self._where(t, key)
        t.end()
        left = lambda df: self._filtered(df, where, key, True, m["fields"][0]["name"]) if where else without(df)
        open_ = self._read(m, [m["open"]]) if m["open"] else None
        self.replace(name, left(self._read(m, m["parts"])), None if open_ is None else left(open_))
