"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a row is a segment, a bounded run of documents with its own dictionary of terms and,
for each term, the sorted positions at which it occurs. Segments have no shared hot term and need no shuffle to build.
A search reads the terms' counts first, so each window knows its rarest term in the whole corpus; in every segment it then
takes that term's positions, shifted by the term's place in the window, and keeps those that the next rarest term's shifted
list has as well, until all terms are confirmed. Terms are compared as bytes, not as hashes.

Test items are taken in blocks of bounded size; a block's windows are broadcast, and each block reads the index again.

Defined cases: null text has no words; an item of fewer words than a window is one window, one without words is none;
matches never cross documents; repeated document rows are judged each for itself; a null item_id hits but isn't listed;
texts are read whole, whatever their length; without documents there are no rows, without test items no hits; other columns
are not read (``drop_contaminated`` returns them as they are), whatever their names.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, settle, stored, two_columns

WINDOW = 13
#: Characters of test items in a block.
BLOCK_CHARS = 4_000_000
#: Digits, letters in lower case and all bytes beyond ASCII make words; A-Z become lower case, the rest blanks.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "doc_ids array<long>, lengths array<int>, terms binary, counts binary, positions binary"
HITS = "segment long, place int, doc_id long, items array<long>, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORDS).split() if text else []


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: segment, doc_ids, lengths, and the segment's terms, counts and positions as packed arrays."""
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])

    def run(batches):
        settle("decontamination")
        for ids, texts in each_text(batches):
            code: dict[bytes, int] = {}
            codes, lengths = [], []
            for t in texts:
                words = words_of(t)
                lengths.append(len(words))
                codes.append(np.array([code.setdefault(w, len(code)) for w in words], np.int32))
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            order = np.argsort(flat, kind="stable").astype(np.uint32)
            counts = np.bincount(flat, minlength=len(code)).astype(np.uint32)
            columns = [[ids], [lengths], [b" ".join(code)], [counts.tobytes()], [order.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    packed = two_columns(df, id_col, text_col).mapInArrow(run, INDEX)
    return stored(packed.withColumn("segment", F.monotonically_increasing_id()), "index")


class Block:
    """Windows of some test items: by length, distinct rows of term numbers, and the items each row belongs to."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        by: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            codes = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            n = min(window, len(codes))
            for k in range(len(codes) - n + 1 if n else 0):
                by.setdefault(n, {}).setdefault(tuple(codes[k : k + n]), set()).add(item)
        self.rows = {n: np.array(list(got), np.int64) for n, got in by.items()}
        self.items = {n: [sorted(i for i in s if i is not None) for s in got.values()] for n, got in by.items()}
        self.order: dict[int, np.ndarray] = {}

    def rarest_first(self, frequency: np.ndarray) -> None:
        """For each window, its places ordered by how often the corpus has their terms."""
        self.order = {n: np.argsort(frequency[rows], axis=1, kind="stable") for n, rows in self.rows.items()}


def phrase(lists: list[np.ndarray], places: list[int]) -> np.ndarray:
    """Starts at which every term stands at its place; lists of positions from the rarest on."""
    at = lists[0] - places[0]
    for other, place in zip(lists[1:], places[1:], strict=True):
        if not at.size:
            break
        want = at + place
        k = np.minimum(np.searchsorted(other, want), len(other) - 1)
        at = at[other[k] == want]
    return at


def proximity(lists: list[np.ndarray], slop: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """Spans around each position of the rarest term in which every other term is at most ``slop`` words away, in the same
    document; ``starts`` are those of the segment's documents."""
    at = low = high = lists[0]
    for other in lists[1:]:
        if not at.size:
            break
        doc = np.searchsorted(starts, at, side="right")
        k = np.searchsorted(other, at)
        after, before = np.minimum(k, len(other) - 1), np.maximum(k - 1, 0)
        far = [np.where(np.searchsorted(starts, other[x], side="right") == doc, np.abs(other[x] - at), slop + 1) for x in (before, after)]
        near, ok = np.where(far[0] <= far[1], other[before], other[after]), np.minimum(*far) <= slop
        low, high, at = np.minimum(low, near)[ok], np.maximum(high, near)[ok], at[ok]
    return list(zip(low.tolist(), (high + 1).tolist(), strict=True))


def unpacked(row: dict) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """A segment's dictionary, the ends of its posting lists and the positions."""
    terms = row["terms"].split(b" ") if row["terms"] else []
    return dict(zip(terms, range(len(terms)), strict=True)), np.frombuffer(row["counts"], np.uint32).astype(np.int64).cumsum(), np.frombuffer(row["positions"], np.uint32)


def find(row: dict, block: Block, slop: int | None = None) -> list[tuple[int, int, list]]:
    """(start, end, items) in the segment's own positions; ``slop`` asks for proximity instead of the exact phrase."""
    code, ends, positions = unpacked(row)
    have = np.full(max(1, len(block.terms)), -1, np.int64)
    for w, k in block.terms.items():
        have[k] = code.get(w, -1)
    starts = np.cumsum([0, *row["lengths"]])
    lists: dict[int, np.ndarray] = {}

    def posting(c: int) -> np.ndarray:
        if c not in lists:
            lists[c] = positions[ends[c - 1] if c else 0 : ends[c]].astype(np.int64)
        return lists[c]

    out = []
    for n, rows in block.rows.items():
        own = have[rows]
        for k in np.flatnonzero((own >= 0).all(axis=1)):
            order = block.order[n][k].tolist()
            if slop is None:
                at = phrase([posting(own[k, i]) for i in order], order)
                spans = [(s, s + n) for s in at.tolist()]
            else:
                spans = proximity([posting(own[k, i]) for i in order], slop, starts)
            out += [(s, e, block.items[n][k]) for s, e in spans if s >= 0 and np.searchsorted(starts, s, side="right") == np.searchsorted(starts, e - 1, side="right")]
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, window: int):
    """Test items in blocks of about BLOCK_CHARS characters, one at a time on the driver."""
    test = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")).filter("text is not null")
    many = max(1, math.ceil((test.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    for k in range(many):
        yield Block([(r["item_id"], r["text"]) for r in test.filter(F.pmod(F.xxhash64("text"), F.lit(many)) == k).collect()], window)


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """A row for each document (segment, place) with matches: its items, and spans of words, start and exclusive end."""
    sc, out = index.sparkSession.sparkContext, []
    hits_schema = pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    for block in blocks(items, id_col, text_col, window):
        terms = sc.broadcast(block.terms)

        def counted(batches, terms=terms):
            total = np.zeros(max(1, len(terms.value)), np.int64)
            for b in batches:
                for r in b.to_pylist():
                    seen, counts = r["terms"].split(b" ") if r["terms"] else [], np.frombuffer(r["counts"], np.uint32)
                    for k, w in enumerate(seen):
                        if w in terms.value:
                            total[terms.value[w]] += counts[k]
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["term", "n"])

        # a row for each term of the block at most
        frequency = np.zeros(max(1, len(block.terms)), np.int64)
        for r in index.select("terms", "counts").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            frequency[r["term"]] = r["n"]
        block.rarest_first(frequency)
        sent = sc.broadcast(block)

        def matched(batches, sent=sent):
            for b in batches:
                for k in range(b.num_rows):
                    r = b.slice(k, 1).to_pylist()[0]
                    starts, by = np.cumsum([0, *r["lengths"]]), {}
                    for s, e, found in find(r, sent.value, slop):
                        place = int(np.searchsorted(starts, s, side="right")) - 1
                        got = by.setdefault(place, (set(), []))
                        got[0].update(found)
                        got[1].append((s - int(starts[place]), e - int(starts[place])))
                    if by:
                        places = sorted(by)
                        columns = [[r["segment"]] * len(by), places, [r["doc_ids"][p] for p in places], [sorted(by[p][0]) for p in places], [[{"start": s, "end": e} for s, e in merged(by[p][1])] for p in places]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, hits_schema, strict=True)], schema=hits_schema)

        # each block's hits are written once
        out.append(stored(index.select("segment", "doc_ids", "lengths", "terms", "counts", "positions").mapInArrow(matched, HITS), "hits"))
        terms.unpersist()
        sent.unpersist()
    return reduce(DataFrame.unionByName, out).groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: float = 0.05) -> DataFrame:
    """doc_id, n_words, n_hit, items and contaminated of every document row."""
    index = build_index(docs)
    hits = search(index, items, window=window).select("segment", "place", "items", "spans")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    covered = F.aggregate(F.array_sort("spans"), start, step)["n"]
    each = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("place", "row")).select("segment", "place", "row.doc_ids", F.col("row.lengths").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return each.join(hits.select("segment", "place", "items", covered.alias("n_hit")), ["segment", "place"], "left").select(
        F.col("doc_ids").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        ((n_hit > 0) & (n_hit / least >= F.col("n_words") - 1e-6)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no window of a test item, whatever their length; texts are known by a 64-bit
    hash, so each row is judged by its own text, whatever its doc_id."""
    name = f"_text_{uuid.uuid4().hex}"  # a name that no column of docs has
    texts = docs.select(F.xxhash64(docs[text_col].cast("string")).alias("doc_id"), docs[text_col].alias("text"))
    gone = search(build_index(texts), items).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.xxhash64(docs[text_col].cast("string")) == gone[name], "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
