"""Exact substring dedup with per-shard suffix arrays.

Texts are laid one after another into units of bounded size, the rows of a stored table. A unit is cut into shards of
``shard`` positions, wherever documents begin, so a text of any length is sorted in bounded pieces. A shard sorts its
suffixes by refinement of ranks after Larsson and Sadakane: groups equal in their first h bytes are split by the rank h
bytes on, and only groups of two and more are looked at again. Common prefixes with the suffix before come from Kasai's
walk in text order, many lanes at once; they part the suffixes into classes that share their first ``length`` bytes, and
the class's smallest document decides inside the shard. As only ``length`` bytes matter, refinement stops once they are
covered.

Between shards only strings that can be shared are exchanged. The anchor of a string is the smallest hash of its 24-byte
grams, so equal strings have equal anchors wherever they stand, and neighbouring strings mostly share theirs.

1. A unit tells which anchors it has, four bytes each, and learns which of them others have too.
2. For those it tells a hash of the bytes of the run of strings with that anchor and the smallest document; an anchor whose
   runs are alike everywhere is decided by that.
3. For anchors whose runs differ it tells the strings one by one, four bytes each, and learns which are shared.
4. For those it tells 96 bits of hashes and the smallest document, and learns the smallest of all where it is another.

Shards merge what comes back into their own strings by binary search. A unit sends each key once, so a passage that very
many documents share costs one row for each unit, and strings are dealt by their own hash, not by their anchor's. The
stored table is bucketed by unit, so texts are not shuffled again.

Defined cases: null and empty texts have no bytes; a string must stand in a document with a smaller doc_id, so rows that
repeat a doc_id don't remove each other's bytes; a null doc_id counts as the greatest; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bucketed, discard, each_text, free_shuffles, rows, stored, two_columns

LENGTH, GRAM = 50, 24
#: Bytes of text in a unit (one longer text is a unit of its own) and positions in a shard.
UNIT, SHARD = 8 << 20, 1 << 20
LAST = (1 << 63) - 1
#: Stands for the smallest document where a unit's runs differ.
MIXED = -(1 << 63)
#: Positions hashed at once, keys merged in one group, and lanes' length in Kasai's walk.
STEP, MERGE, LANE = 1 << 15, 1 << 19, 64
#: Kinds of notes that a unit gets back.
ANCHORS, RUNS, STRINGS, LEAST = range(4)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def words8(data: bytes, at: int, n: int) -> np.ndarray:
    """The eight bytes from each of ``n`` positions on as one big-endian number."""
    out = np.empty((n + 7) // 8 * 8, np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(data, ">u8", len(out) // 8, at + k)
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * C3
    return x ^ x >> np.uint64(29)


def suffix_order(w: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share half of ``depth`` bytes or more with another, sorted, and the rank of each at that depth."""
    order = np.argsort(w[:n]).astype(np.int32)
    rank = np.full(n + depth + 64, -1, np.int32)
    first = np.ones(n, bool)
    key = w[order]
    first[1:] = key[1:] != key[:-1]
    del key
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), np.int32(0)))
    h = 8
    while h < depth:
        last = np.ones(len(order), bool)
        last[:-1] = first[1:]
        many = ~(first & last)  # single suffixes are in their place
        order, own = order[many], rank[order[many]]
        if not len(order):
            break
        again = np.argsort(own.astype(np.int64) << np.int64(32) | rank[order + h] + np.int64(1))
        order, own = order[again], own[again]
        nxt = rank[order + h]
        first = np.ones(len(order), bool)
        start = np.ones(len(order), bool)
        start[1:] = own[1:] != own[:-1]
        first[1:] = start[1:] | (nxt[1:] != nxt[:-1])
        at = np.arange(len(order), dtype=np.int32)
        rank[order] = own + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))
        h *= 2
    return order, rank[order]


BYTES = np.array([1 << 8 * k for k in range(8)], np.uint64)


def kasai(w: np.ndarray, n: int, order: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """For each sorted suffix the bytes it shares with the one before, ``depth`` at most.

    A suffix shares at least what the one before it in the text shares, less one byte, so the walk starts from there. That
    holds where both are sorted, that is while half of ``depth`` is left, away from the end and not for suffixes that equal
    each other over the whole depth; there it starts from nothing. Lanes of the text walk at the same time.
    """
    before, tie = np.full(n, -1, np.int32), np.zeros(n, bool)
    before[order[1:]], tie[order[1:]] = order[:-1], rank[1:] == rank[:-1]
    shared = np.where(tie, np.uint8(depth), np.uint8(0))
    for step in range(min(LANE, n)):
        i = np.arange(step, n, LANE)
        j = before[i].astype(np.int64)
        live = np.flatnonzero((j >= 0) & ~tie[i])
        i, j = i[live], j[live]
        h = np.zeros(len(i), np.int64)
        if step:
            had, other = shared[i - 1], before[i - 1]
            safe = (had < depth) & (had > depth // 2) & (np.maximum(i, other) < n - 2 * depth)
            h[safe] = had[safe] - 1
        live = np.arange(len(i))
        while len(live):
            x = w[i[live] + h[live]] ^ w[j[live] + h[live]]
            h[live] += 8 - np.searchsorted(BYTES, x, side="right")
            live = live[(x == 0) & (h[live] < depth)]
        shared[i] = np.minimum(h, depth)
    return shared[order]


class Unit:
    """Texts laid one after another, and their documents."""

    def __init__(self, ids: list, raw: list[bytes], length: int = LENGTH, shard: int = SHARD):
        self.ids, self.length, self.shard = ids, length, shard
        self.starts = np.cumsum([0, *map(len, raw)])
        self.bytes, self.n = b"".join(raw), int(self.starts[-1])
        self.padded = self.bytes + b"\xff" * (4 * length + 256)
        self.doc = np.array([LAST if i is None else i for i in ids], np.int64)

    @classmethod
    def of(cls, r: dict, length: int, shard: int) -> Unit:
        ends = np.cumsum([0, *r["lengths"]]).tolist()
        data = zstandard.decompress(r["data"]) if ends[-1] else b""
        return cls(r["doc_ids"], [data[a:b] for a, b in zip(ends, ends[1:])], length, shard)

    def shards(self):
        for at in range(0, self.n, self.shard):
            yield Shard(self, at, min(self.shard, self.n - at))


class Shard:
    """``n`` positions of a unit from ``at`` on; its suffixes reach ``more`` bytes further, so that every string is whole."""

    def __init__(self, unit: Unit, at: int, n: int):
        self.unit, self.at, self.n, self.length = unit, at, n, unit.length
        self.more = min(2 * self.length, unit.n - at - n)
        self.w = words8(unit.padded, at, n + self.more + 128)
        # the last length - 1 positions of a document, all of a shorter one, start no whole string
        k = slice(np.searchsorted(unit.starts[1:], at, "right"), np.searchsorted(unit.starts[1:], at + n + self.length, "left"))
        ends, sizes = unit.starts[1:][k], np.diff(unit.starts)[k]
        low, high = np.maximum(ends - np.minimum(self.length - 1, sizes), at) - at, np.minimum(ends, at + n) - at
        edge = np.zeros(n + 1, np.int8)
        np.add.at(edge, low[low < high], 1)
        np.add.at(edge, high[low < high], -1)
        self.valid = np.cumsum(edge[:-1], dtype=np.int8) == 0

    def doc(self, p: np.ndarray) -> np.ndarray:
        """The document at each position."""
        return self.unit.doc[np.searchsorted(self.unit.starts, p + self.at, side="right") - 1]

    def anchors(self) -> np.ndarray:
        """The anchor of the string at each position (of no use where it isn't valid)."""
        span = self.length - GRAM + 1
        out = np.empty(self.n, np.uint64)
        for at in range(0, self.n, STEP):  # small enough for the processor's cache
            n = min(STEP, self.n - at)
            w, size, wide = self.w[at : at + n + span + 16], n + span - 1, 1
            low = mix(mix(w[:size] + w[8 : size + 8] * C1 + w[16 : size + 16] * C2))
            while wide * 2 <= span:
                low = np.minimum(low[:-wide], low[wide:])
                wide *= 2
            if span > wide:
                low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
            out[at : at + n] = low[:n]
        return np.maximum(out, np.uint64(1))  # 0 stands for none

    def runs(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, anchor and number of strings of each run of valid strings with one anchor; periodic text is cut."""
        own = np.where(self.valid, anchor, np.uint64(0))
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(np.append(begin, self.n))
        begin, size = begin[own[begin] != 0], size[own[begin] != 0]
        most = self.length - GRAM + 1
        if len(size) and size.max() > most:
            many = -(-size // most)
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin, size = np.repeat(begin, many) + k * most, np.minimum(np.repeat(size, many) - k * most, most)
        return begin, own[begin], size

    def code(self, p: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """A hash of the ``size`` bytes from each position on, ``length`` at least."""
        sizes = np.broadcast_to(np.asarray(size, np.int64), p.shape)
        out = mix(sizes.astype(np.uint64) * C1)
        for k in range(0, int(sizes.max(initial=0)) - 7, 8):
            if k + 8 <= self.length:
                out = mix(out + self.w[p + k])
            else:
                some = np.flatnonzero(sizes >= k + 8)
                out[some] = mix(out[some] + self.w[p[some] + k])
        return mix(out + self.w[p + sizes - 8])

    def asked(self, anchor: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Positions of valid strings whose anchor is among the sorted ``wanted``."""
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))  # neighbours mostly share theirs
        hit, _ = find(wanted, anchor[new])
        return np.flatnonzero(np.repeat(hit, np.diff(np.append(new, self.n))) & self.valid)

    def strings(self, anchor: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, key and code of each string whose anchor is asked for."""
        p = self.asked(anchor, wanted)
        code = self.code(p, self.length)
        return p, mix(mix(anchor[p] * C2 + code) + C1), code

    def local(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose string stands in the shard several times, and the smallest document that has it."""
        none, m = (np.zeros(0, np.int64),) * 2, self.n + self.more
        depth = 1 << (self.length - 1).bit_length()
        order, rank = suffix_order(self.w, m, depth)
        if len(order) < 2:
            return none
        same = np.concatenate(([False], kasai(self.w, m, order, rank, depth)[1:] >= self.length))
        of, own = np.cumsum(~same), order < self.n
        own[own] = self.valid[order[own]]
        order, of = order[own].astype(np.int64), of[own]
        first = np.ones(len(order), bool)
        first[1:] = of[1:] != of[:-1]
        last = np.append(first[1:], True)
        many = ~(first & last)
        order, first = order[many], first[many]
        if not len(order):
            return none
        begin, doc = np.flatnonzero(first), self.doc(order)
        return order, np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(order))))


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: which of ``wanted`` are among the keys, and where."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return sorted_keys[at] == wanted, at


# Exchange: sorted keys are dealt into buckets by their leading bits ---------------------------------------------------------

SENT, NOTE = "bucket long, unit long, data binary", "unit long, kind int, bucket long, data binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("data", pa.binary())])
NOTE_SCHEMA = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("data", pa.binary())])


def place(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key in the upper 32 bits, what follows in the lower ones; in the order of the keys."""
    b, low = np.uint64(buckets), np.uint64(32)
    return (keys >> low) * b + ((keys & np.uint64(0xFFFFFFFF)) * b >> low)


def parts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sorted places, and where each begins and the last ends."""
    bucket = (places >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return bucket[begin], np.append(begin, len(bucket))


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns byte plane by byte plane, compressed: the upper bytes of documents and of differences are mostly zero."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns), 1)


def opened(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, wide in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).reshape(n))
        at += n * wide
    return out


def presence(unit: int, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted distinct keys of a unit: what follows the bucket, as differences."""
    places = place(keys, buckets)
    named, ends = parts(places)
    rest = places.astype(np.uint32)
    return rows(SENT_SCHEMA, named, [unit] * len(named), [squeezed(np.diff(rest[a:b], prepend=np.uint32(0))) for a, b in zip(ends, ends[1:])])


def shared(sent: DataFrame, kind: int) -> DataFrame:
    """For each unit and bucket a bit for each key sent: whether another unit sent it too."""

    def merge(group: pa.Table) -> pa.Table:
        unit, got = group.column("unit").to_pylist(), [np.cumsum(opened(d, np.uint32)[0], dtype=np.uint32) for d in group.column("data").to_pylist()]
        keys = np.concatenate(got)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        flag = np.zeros(len(keys), bool)
        flag[order[1:][same]] = flag[order[:-1][same]] = True
        cut = np.split(flag, np.cumsum([len(g) for g in got])[:-1])
        return pa.Table.from_batches([rows(NOTE_SCHEMA, unit, [kind] * len(unit), group.column("bucket").to_pylist(), [np.packbits(f).tobytes() for f in cut])])

    return sent.groupBy("bucket").applyInArrow(merge, NOTE)


def values(unit: int, keys: np.ndarray, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns of a unit's sorted keys, dealt by the keys."""
    named, ends = parts(place(keys, buckets))
    return rows(SENT_SCHEMA, named, [unit] * len(named), [squeezed(*(c[a:b] for c in columns)) for a, b in zip(ends, ends[1:])])


#: Columns that units tell, and that they get back: a key, a check of its bytes, the smallest document, whether several of
#: the unit's shards have the key. A run's key is its anchor.
TOLD = {RUNS: (np.uint64, np.uint64, np.int64, np.uint8), LEAST: (np.uint64, np.uint32, np.int64, np.uint8)}


def decided(sent: DataFrame, kind: int) -> DataFrame:
    """For each unit and bucket the keys and least documents that its shards don't know; MIXED where runs differ."""

    def merge(group: pa.Table) -> pa.Table:
        unit, got = group.column("unit").to_pylist(), [opened(d, *TOLD[kind]) for d in group.column("data").to_pylist()]
        key, check, doc, several = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((check, key)) if kind == LEAST else np.argsort(key, kind="stable")
        k, c = key[order], check[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        if kind == LEAST:
            new[1:] |= c[1:] != c[:-1]
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[order], begin)  # MIXED where a unit's own runs differ
        if kind == RUNS:
            least[np.minimum.reduceat(c, begin) != np.maximum.reduceat(c, begin)] = MIXED
        told = np.empty_like(doc)
        told[order] = np.repeat(least, np.diff(np.append(begin, len(k))))
        tell = (told < doc) | (told == MIXED) | (several > 0)
        ends = np.cumsum([0, *(len(g[0]) for g in got)])
        data = [squeezed(key[a:b][tell[a:b]], told[a:b][tell[a:b]]) for a, b in zip(ends, ends[1:])]
        return pa.Table.from_batches([rows(NOTE_SCHEMA, unit, [kind] * len(unit), group.column("bucket").to_pylist(), data)])

    return sent.groupBy("bucket").applyInArrow(merge, NOTE)


class Notes:
    """What a unit got back, by kind."""

    def __init__(self, notes: list[dict] | None):
        self.by: dict[int, dict] = {}
        for x in sorted(notes or (), key=lambda x: (x["kind"], x["bucket"])):
            self.by.setdefault(x["kind"], {})[x["bucket"]] = x["data"]

    def flags(self, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
        """The bit of each of the unit's sorted keys."""
        named, ends = parts(place(keys, buckets))
        out = [np.unpackbits(np.frombuffer(self.by[kind][b], np.uint8), count=e - s) for b, s, e in zip(named.tolist(), ends, ends[1:])]
        return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)

    def told(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted anchors of runs, or keys of strings, and their least documents."""
        keys, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for data in self.by.get(kind, {}).values():
            key, doc = opened(data, np.uint64, np.int64)
            keys.append(key)
            least.append(doc)
        key, doc = np.concatenate(keys), np.concatenate(least)
        order = np.argsort(key, kind="stable")
        return key[order], doc[order]

    def asked(self) -> np.ndarray:
        """Sorted anchors that are to be told string by string."""
        anchors, least = self.told(RUNS)
        return anchors[least == MIXED]


class Groups:
    """Keys of a unit's shards, grouped: distinct and sorted, and whether several shards have each."""

    def __init__(self, found: list[np.ndarray]):
        every = np.concatenate([np.zeros(0, np.uint64), *found])
        which = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
        self.order = np.argsort(every)
        every = every[self.order]
        self.begin = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        self.keys = every[self.begin]
        self.several = self.ends(np.minimum, [which]) != self.ends(np.maximum, [which])

    def ends(self, how: np.ufunc, columns: list[np.ndarray]) -> np.ndarray:
        """The least or the greatest value of each group."""
        column = np.concatenate(columns)[self.order] if columns else np.zeros(0, np.int64)
        return how.reduceat(column, self.begin) if len(self.begin) else column[:0]


def dedup(df: DataFrame, length: int = LENGTH, size: int = UNIT, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row and, ``with_text``, the spans and the bytes kept."""
    texts = two_columns(df, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, packed = 1 + total // 12 // MERGE, pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])

    def pack(batches):
        for ids, some in each_text(batches, size):
            raw = [t.encode("utf-8", "replace") if t else b"" for t in some]
            yield rows(packed, [ids], [[len(r) for r in raw]], [zstandard.compress(b"".join(raw), 3)])

    laid = texts.mapInArrow(pack, "doc_ids array<long>, lengths array<long>, data binary").select(F.monotonically_increasing_id().alias("unit"), "*")
    units = bucketed(laid, "units", "unit", 1 + int(total // (2 * size)))
    notes: list[DataFrame] = []

    def each(batches):
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                yield r["unit"], Unit.of(r, length, shard), Notes(r["notes"])

    def ask(step, kind: str) -> DataFrame:
        """Run a step over all units, each with the notes it got so far."""
        got = units.withColumn("notes", F.lit(None).cast("array<struct<kind:int,bucket:long,data:binary>>"))
        if notes:
            every = notes[0]
            for n in notes[1:]:
                every = every.unionByName(n)
            # a row for each bucket a unit has keys in: bounded by the unit's size
            by = every.groupBy("unit").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias("notes"))
            got = units.join(by.hint("shuffle_hash"), "unit", "left")
        return got.select("unit", "doc_ids", "lengths", "data", "notes").mapInArrow(step, kind)

    def tell_anchors(batches):
        for unit, u, _ in each(batches):
            yield presence(unit, Groups([s.runs(s.anchors())[1] for s in u.shards()]).keys, buckets)

    def tell_runs(batches):
        for unit, u, had in each(batches):
            anchors, codes, docs = [], [], []
            for s in u.shards():
                p, a, n = s.runs(s.anchors())
                anchors.append(a)
                codes.append(s.code(p, n + length - 1))
                docs.append(s.doc(p))
            g = Groups(anchors)
            tell = g.several | had.flags(ANCHORS, g.keys, buckets)
            code, alike = g.ends(np.minimum, codes), g.ends(np.minimum, codes) == g.ends(np.maximum, codes)
            # one row for an anchor: where its runs differ, that is all there is to tell
            doc = np.where(alike, g.ends(np.minimum, docs), MIXED)
            keys = g.keys[tell]
            yield values(unit, keys, buckets, keys, code[tell], doc[tell], g.several[tell].view(np.uint8))

    def tell_strings(batches):
        for unit, u, had in each(batches):
            wanted = had.asked()
            yield presence(unit, Groups([s.strings(s.anchors(), wanted)[1] for s in u.shards()] if len(wanted) else []).keys, buckets)

    def tell_least(batches):
        for unit, u, had in each(batches):
            wanted, keys, codes, docs = had.asked(), [], [], []
            for s in u.shards() if len(wanted) else ():
                p, key, code = s.strings(s.anchors(), wanted)
                keys.append(key)
                codes.append(code.astype(np.uint32))
                docs.append(s.doc(p))
            g = Groups(keys)
            tell = g.several | had.flags(STRINGS, g.keys, buckets)
            columns = g.ends(np.minimum, codes).astype(np.uint32), g.ends(np.minimum, docs), g.several.view(np.uint8)
            yield values(unit, g.keys[tell], buckets, g.keys[tell], *(c[tell] for c in columns))

    spark = df.sparkSession
    for step, merge, kind in ((tell_anchors, shared, ANCHORS), (tell_runs, decided, RUNS), (tell_strings, shared, STRINGS), (tell_least, decided, LEAST)):
        with batches_of(spark, 2):
            notes.append(stored(merge(ask(step, SENT), kind), "notes"))
        free_shuffles(spark)
        if len(notes) > 1 and kind in (RUNS, LEAST):
            discard(spark, notes.pop(-2))  # the bits have been used

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())] if with_text else []))

    def cut(batches):
        for _, u, had in each(batches):
            runs, strings, wanted = had.told(RUNS), had.told(LEAST), had.asked()
            gone = [removed(s, runs, strings, wanted) for s in u.shards()]
            yield rows(out_schema, *reported(u, np.concatenate(gone or [np.zeros(0, np.int64)]), with_text))

    shown = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<array<long>>, kept binary" if with_text else "")
    with batches_of(spark, 2):
        out = stored(ask(cut, shown), "deduplicated")
    discard(spark, units, *notes)
    return out


def removed(s: Shard, runs: tuple, strings: tuple, wanted: np.ndarray) -> np.ndarray:
    """Positions in the unit of strings that a smaller document has: by the shard's own classes and by what came back."""
    best = np.full(s.n, LAST)
    p, least = s.local()
    best[p] = least
    anchor = s.anchors()
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    hit, at = find(runs[0], anchor[new])
    if hit.any():
        told = np.where(hit, runs[1][at], LAST)
        told[told == MIXED] = LAST
        best = np.minimum(best, np.repeat(told, np.diff(np.append(new, s.n))))
    if len(wanted) and len(strings[0]):
        p, key, _ = s.strings(anchor, wanted)
        hit, at = find(strings[0], key)
        best[p[hit]] = np.minimum(best[p[hit]], strings[1][at[hit]])
    some = np.flatnonzero(s.valid & (best < LAST))
    return some[best[some] < s.doc(some)] + s.at


def reported(u: Unit, gone: np.ndarray, with_text: bool) -> list[list]:
    """The result's columns for the documents of a unit."""
    edge = np.zeros(u.n + 1, np.int8)
    if len(gone):
        first = np.concatenate(([True], gone[1:] > gone[:-1] + u.length))
        edge[gone[first]] = 1
        edge[gone[np.append(np.flatnonzero(first)[1:] - 1, len(gone) - 1)] + u.length] -= 1
    mask, data = np.cumsum(edge[:-1], dtype=np.int8).view(bool), np.frombuffer(u.bytes, np.uint8)
    columns: list[list] = [[] for _ in range(7 if with_text else 5)]
    for k, doc in enumerate(u.ids):
        a, e = u.starts[k], u.starts[k + 1]
        own = mask[a:e]
        n = int(np.count_nonzero(own))
        turns = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))) if n else np.zeros(0, np.int64)
        kept = data[a:e][~own].tobytes() if n else u.bytes[a:e]
        row = [doc, int(e - a), n, len(turns) // 2, hashlib.sha256(kept).hexdigest()]
        for column, v in zip(columns, [*row, turns.reshape(-1, 2).tolist(), kept] if with_text else row, strict=True):
            column.append(v)
    return columns


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
