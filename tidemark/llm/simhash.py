"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments. Two fingerprints that differ in at most two bits agree in one whole
segment (pigeonhole) and differ by at most two bits in the segment after it. The perfect Golay code (23, 12) maps that
segment to the indices of the codewords near it: the nearest codeword of the segment and of everything one bit away.
Segments within two bits of each other share a point one bit from both, so they share an index. A key is the number and
bits of the whole segment with one such index: about 16 keys for a fingerprint and segment. Equal fingerprints are one
node, however often they occur.

Fingerprints that share a key with another are joined and verified without listing pairs, whatever a key's size: each is
joined through the 65 points within one bit of it. Fingerprints within two bits share such a point, those that share one
are within two bits, and a point has at most 65 fingerprints, so linking each to the smallest there loses no link.

Components come from alternating large and small stars over the links, each round cut by a checkpoint.

Defined cases: null and empty texts have no words and the fingerprint zero, linked like any other; a text of fewer words
than a shingle is one shingle; texts are hashed whole, in pieces of bounded memory; rows that repeat a doc_id are judged
each by its text; a component without any doc_id has a null one; an empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, each_text, rows, stored, two_columns

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width
GENERATOR = 0b110001110101  # of the Golay code (23, 12)
AT_ONCE = 1 << 14


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles, as a signed 64-bit number."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    firsts, lasts = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(firsts), AT_ONCE):
        some = b"".join([digest(joined[s:e], 42) for s, e in zip(firsts[at : at + AT_ONCE], lasts[at : at + AT_ONCE], strict=True)])
        bits = np.unpackbits(np.frombuffer(some, np.uint8)).reshape(-1, 64)
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(firsts)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (long) of each row; a narrow pass over whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for ids, texts in each_text(batches):
            yield rows(schema, ids, [fingerprint(t, shingle) for t in texts])

    return two_columns(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - 11
    return word


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the lower 12 and upper 11 bits, and the error of weight 3 at most that each remainder stands for."""
    low, high = (np.array([remainder(v << s) for v in range(1 << n)], np.int32) for s, n in ((0, 12), (12, 11)))
    error = np.zeros(1 << 11, np.int32)
    for a in range(23):
        error[remainder(1 << a)] = 1 << a
        for b in range(a):
            error[remainder(1 << a | 1 << b)] = 1 << a | 1 << b
            for c in range(b):
                error[remainder(1 << a | 1 << b | 1 << c)] = 1 << a | 1 << b | 1 << c
    return low, high, error


def nearest(v: np.ndarray) -> np.ndarray:
    """The index of the one codeword within three bits of each 23-bit vector."""
    low, high, error = golay()
    return (v ^ error[low[v & 0xFFF] ^ high[v >> 12]]) >> 11


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint and the row each belongs to."""
    bits = fp.view(np.uint64)
    parts = [(bits >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int32) for s, w in SEGMENTS]
    keys, owner = [], []
    for i, whole in enumerate(parts):
        near, width = parts[(i + 1) % 3], SEGMENTS[(i + 1) % 3][1]
        flips = np.array([0, *(1 << b for b in range(width))], np.int32)
        index = np.sort(nearest(near[:, None] ^ flips), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(first)
        keys.append(np.int64(i) << 36 | whole[row].astype(np.int64) << 12 | index[row, col])
        owner.append(row)
    return np.concatenate(keys), np.concatenate(owner)


def with_keys(nodes: DataFrame) -> DataFrame:
    """key, node, fp: a row for each key of each distinct fingerprint."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                node, fp = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                key, owner = keys_of(np.ascontiguousarray(fp, np.int64))
                yield rows(schema, pa.array(key), pa.array(node[owner]), pa.array(fp[owner]))

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints differ in at most two bits; enough of them to hold every component."""
    keyed = with_keys(nodes)
    company = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    near = keyed.join(company, "key", "left_semi").select("node", "fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")) for k in range(64)])
    points = near.select("node", F.explode(around).alias("point"))
    met = points.groupBy("point").agg(F.array_sort(F.collect_list("node")).alias("nodes")).filter(F.size("nodes") > 1)  # 65 at most
    return met.select(F.col("nodes")[0].alias("a"), F.explode(F.slice("nodes", 2, 64)).alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node that has an edge (a, b)."""
    state = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    mark = None
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        state = checkpoint(small)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id of each row: the smallest doc_id that links of at most two bits reach."""
    prints = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    groups = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(links(groups.select(F.col("fp").alias("node"), "fp"))).withColumnRenamed("node", "fp")
    linked = found.unionByName(found.select(F.col("component").alias("fp"), "component").distinct())
    named = groups.join(linked, "fp").groupBy("component").agg(F.min("least").alias("shared"))
    alone = groups.filter("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("shared"))
    shared = linked.join(named, "component").select("fp", "shared").unionByName(alone).withColumn("many", F.lit(True))
    return prints.join(shared, "fp", "left").select("doc_id", "fp", F.when(F.col("many"), F.col("shared")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
