"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least ``LEAST``, one of each group kept.

A node is a distinct set of shingles, named by a 64-bit hash of the set. Its SimHash fingerprint goes through the Golay
keys of ``simhash`` first: nodes of a component there are held against its smallest node, and those similar enough are one
from then on. Two bits reach close copies only (a pair at similarity 0.8 differs in about ten of 64 bits, too many for a
code that corrects three of 23 and keeps keys selective), so wider pairs come from bands of min-hashes: ``BANDS`` bands
of ``DEEP`` hashes miss a pair at similarity 0.8 with a chance of (1 - 0.8^5)^30 = 7e-6, closer ones more rarely. Every pair
is verified on the texts: the similarity of the two sets (held as 64-bit hashes) is counted exactly.

In a band, of any size, each node is first held against one centre, the node that shares most. Nodes of bands that still
hold several components are then compared across components where they share one of their rarest shingles (an exact prefix
filter). So no component is lost, a large group of near copies of one text costs a comparison a member instead of its
square, and documents with a common passage only aren't compared.

Defined cases: as in ``simhash``, words are split at ASCII white space and ASCII letters become lower case; texts without
words are copies of each other; a text of fewer words than a shingle is one shingle; texts are read whole; a row without
a doc_id counts as the greatest; rows that repeat a doc_id are judged each by its text (known by a 64-bit hash), of rows
that are the same in both one stays; an empty table stays empty; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, checkpoint, discard, free_shuffles, rows, settle, stored
from .simhash import components, links

LEAST, SHINGLE = 0.8, 5
LAST = (1 << 63) - 1
BANDS, DEEP = 30, 5
AT_ONCE, BUCKETS = 1 << 11, 1 << 18
_RNG = np.random.default_rng(7)
FACTORS = (_RNG.integers(0, 1 << 32, BANDS * DEEP, dtype=np.uint32) | np.uint32(1))[:, None]
OFFSETS = _RNG.integers(0, 1 << 32, BANDS * DEEP, dtype=np.uint32)[:, None]
MIX = _RNG.integers(0, 1 << 63, DEEP, dtype=np.uint64) | np.uint64(1)
BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    found = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(found, np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set, one for each band; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.min([(low[None, at : at + AT_ONCE] * FACTORS + OFFSETS).min(1) for at in range(0, len(low), AT_ONCE)], axis=0)
    key = (least.reshape(BANDS, DEEP).astype(np.uint64) * MIX).sum(1, dtype=np.uint64) ^ BAND
    key = (key ^ key >> np.uint64(29)) * MIX[0]
    return (key ^ key >> np.uint64(32)).view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed 64-bit number; zero for an empty set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(found), AT_ONCE):
        total += np.unpackbits(found[at : at + AT_ONCE].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(found)).tobytes(), "big", signed=True)


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """What a row is known by: its doc_id, the greatest number where it has none, and a hash of its text."""
    return F.coalesce(df[id_col].cast("long"), F.lit(LAST)), F.xxhash64(df[text_col].cast("string"))


def parts(batches, most: int = 4 << 20):
    """Slices of batches with at most ``most`` bytes, one row at least."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def prints(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rid, th, node (hash of the set of shingles), its size, fingerprint and keys of each row; a narrow pass over whole texts."""
    schema = pa.schema([("rid", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        settle("near copies")
        for b in parts(batches):
            nodes, sizes, fps, keys = [], [], [], []
            for t in b.column(2).to_pylist():
                found = shingles(t, shingle)
                nodes.append(int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "big", signed=True))
                sizes.append(len(found))
                fps.append(fingerprint(found))
                keys.append(bands(found))
            yield rows(schema, b.column(0), b.column(1), nodes, sizes, fps, keys)

    return texts.mapInArrow(run, "rid long, th long, node long, size int, fp long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough; texts: node, text."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        settle("near copies")
        last, own = None, None  # pairs come in the order of a
        for batch in batches:
            good = []
            for a, b, text, other in zip(*(batch.column(k) for k in range(4)), strict=True):
                a = a.as_py()
                if own is None or a != last:
                    last, own = a, shingles(text.as_py(), shingle)
                if similarity(own, shingles(other.as_py(), shingle)) >= least:
                    good.append((a, b.as_py()))
            if good:
                yield rows(schema, *map(list, zip(*good, strict=True)))

    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = stored(texts.join(used, "node", "left_semi"), "texts")
    one, two = some.select(F.col("node").alias("a"), "text"), some.select(F.col("node").alias("b"), F.col("text").alias("other"))
    with batches_of(texts.sparkSession, 500):
        out = checkpoint(pairs.join(two, "b").join(one, "a").select("a", "b", "text", "other").mapInArrow(run, "a long, b long").distinct())
    discard(texts.sparkSession, some)
    free_shuffles(texts.sparkSession)
    return out


def rare(texts: DataFrame, apart: DataFrame, least: float, shingle: int) -> DataFrame:
    """key, node, at, size, own: each node's rarest shingles, so many that nodes which are similar enough share one of them.

    Of n shingles at least ``least`` of n are shared, so the first n - least n + 1 in any common order hold a shared one.
    """
    spark = texts.sparkSession
    some = stored(texts.join(apart.select("node").distinct(), "node", "left_semi"), "apart")

    def counted(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in parts(batches):
            found = np.concatenate([shingles(t, shingle) for t in b.column(1).to_pylist()])
            total += np.bincount((found % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    common = np.zeros(BUCKETS, np.int64)
    for r in some.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        common[r["bucket"]] = r["n"]
    sent = spark.sparkContext.broadcast(common)
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("at", pa.int32())])

    def first(batches):
        for b in parts(batches):
            keys, owner, at = [np.zeros(0, np.int64)], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = shingles(t, shingle)
                order = np.lexsort((found, sent.value[(found % np.uint64(BUCKETS)).astype(np.int64)]))
                keys.append(found[order[: len(found) - math.ceil(least * len(found) - 1e-9) + 1]].view(np.int64))
                owner += [i] * len(keys[-1])
                at += range(len(keys[-1]))
            yield rows(schema, pa.array(np.concatenate(keys)), owner, at)

    out = stored(some.mapInArrow(first, "key long, node long, at int").join(apart, "node").select("key", "node", "at", "size", "own"), "rare")
    discard(spark, some)
    return out


def across(held: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that share a key and are of different components; within the key's main component none is looked at.

    The first key that a pair shares stands at places which leave room for all that it shares, else the pair isn't similar.
    """
    owns = held.groupBy("key", "own").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("many"), F.max(F.struct("n", "own")).alias("m"))
    main = checkpoint(owns.filter("many > 1").select("key", F.col("m.own").alias("main")))
    outside = held.join(main, "key").filter("own != main").select("key", "node", "at", "size", "own")
    against = held.join(main, "key", "left_semi").select("key", F.col("node").alias("other"), F.col("at").alias("other_at"), F.col("size").alias("other_size"), F.col("own").alias("other_own"))
    alike = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at")) >= least / (1 + least) * (F.col("size") + F.col("other_size")) - 1e-6
    return outside.join(against, "key").filter("own != other_own").filter(alike).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def grouped(df: DataFrame, id_col: str, text_col: str, least: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The stored prints (rid, th, node) of all rows, and the component of each node that has links."""
    rid, th = row_key(df, id_col, text_col)
    texts = df.select(rid.alias("rid"), th.alias("th"), df[text_col].cast("string").alias("text"))
    found = stored(prints(texts.select("rid", "th", "text"), shingle), "prints")
    first = found.groupBy("node").agg(F.min(F.struct("rid", "th")).alias("r")).select("node", "r.rid", "r.th")
    nodes = stored(found.join(first, ["node", "rid", "th"]).dropDuplicates(["node"]), "nodes")
    whole = texts.join(nodes.select("node", "rid", "th"), ["rid", "th"]).select("node", "text").dropDuplicates(["node"])

    same = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    equal = nodes.join(same.withColumnRenamed("node", "a"), "fp").filter("node != a").select("a", F.col("node").alias("b"))
    close = components(checkpoint(links(same.select("node", "fp")).unionByName(equal)))
    held = verified(checkpoint(close.select(F.col("component").alias("a"), F.col("node").alias("b"))), whole, least, shingle)

    named = nodes.join(held.select(F.col("b").alias("node"), F.col("a").alias("own")), "node", "left").select("keys", "node", "size", F.coalesce("own", "node").alias("own"))
    keyed = stored(named.select(F.explode("keys").alias("key"), "node", "size", "own").distinct(), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("own").alias("low"), F.max("own").alias("high"))
    many = stored(keyed.join(checkpoint(sizes.filter("low != high").select("key", "n")), "key"), "mixed")
    alike = F.least("size", "other_size") >= least * F.greatest("size", "other_size") - 1e-6
    ordered = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))

    weights = many.groupBy("node").agg(F.sum("n").alias("weight"))
    best = F.max(F.struct("weight", "node", "size", "own"))
    centres = checkpoint(many.join(weights, "node").groupBy("key").agg(best.alias("m")).select("key", F.col("m.node").alias("other"), F.col("m.size").alias("other_size"), F.col("m.own").alias("other_own")))
    stars = many.join(centres, "key").filter("own != other_own").filter(alike).select(*ordered)
    wide = checkpoint(verified(checkpoint(stars.distinct()), whole, least, shingle).unionByName(held))
    reached = components(wide)

    called = many.drop("own").join(reached, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("own"))
    mixed = called.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low != high").select("key")
    apart = checkpoint(called.join(mixed, "key").select("node", "size", "own").distinct())
    if not apart.isEmpty():
        held = rare(whole, apart, least, shingle)
        rest = checkpoint(across(held, least))
        discard(df.sparkSession, held)
        reached = components(checkpoint(wide.unionByName(verified(rest, whole, least, shingle))))
    discard(df.sparkSession, nodes, keyed, many)
    return found.select("rid", "th", "node"), reached


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and component_id of each row: the smallest doc_id that links of similar documents reach."""
    found, reached = grouped(df, id_col, text_col, least, shingle)
    lowest = found.groupBy("node").agg(F.min("rid").alias("least")).join(reached, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    named = lowest.join(lowest.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return found.join(named, "node").select(known("rid").alias("doc_id"), known("component_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, that come first in their component by doc_id; of repeated rows one."""
    found, reached = grouped(docs, id_col, text_col, least, shingle)
    first = found.groupBy("node").agg(F.min(F.struct("rid", "th")).alias("r")).join(reached, "node", "left")
    kept = first.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("r").alias("r")).select("r.rid", "r.th")
    often = found.groupBy("rid", "th").count().filter("count > 1").select("rid", "th", F.lit(True).alias("often"))
    a, b, c = (f"_{n}_{uuid.uuid4().hex}" for n in ("rid", "th", "often"))  # names that no column of docs has
    kept = checkpoint(kept.join(often, ["rid", "th"], "left").select(F.col("rid").alias(a), F.col("th").alias(b), F.coalesce("often", F.lit(False)).alias(c)))
    rid, th = row_key(docs, id_col, text_col)
    chosen = docs.join(kept, (rid == kept[a]) & (th == kept[b]))
    once = chosen.filter(~F.col(c)).unionByName(chosen.filter(F.col(c)).dropDuplicates([a, b]))
    return once.select(*docs.columns)
