"""Packing by minimum bin slack.

A document is cut into whole windows and a remainder. How the remainders share windows depends only on how many there are
of each length, a histogram of at most ``size`` numbers, so the plan is made on the driver from that alone, whatever the
size of the corpus. The plan takes the longest length left, finds the multiset of lengths that fills the window closest to
its capacity (subset sums as bits of one integer, counts by backtracking) and applies it as often as the histogram allows.

Pieces get their places by rank within their length. Ranks are counted inside a partition while tokenizing and shifted by
the counts of the partitions before it, so one length that a third of all rows have never meets in one task.

Defined cases: a null or empty text is the closing token alone; a text longer than a window is cut wherever it ends, whole
texts are tokenized; repeated rows are packed each for itself; of multisets that fill a window alike the same one is taken for the
same histogram; an empty table gives no pieces; a
null doc_id stays null; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import each_text, holds, rows, settle, stored, two_columns

SIZE = 2048
END = 1
#: Bytes of text that are tokenized at once; the library keeps about a hundred bytes for each of their tokens.
AT_ONCE = 1 << 20
#: Tokens of words that a worker remembers in each of two halves; the older half goes when the newer is full.
HELD = 1 << 17
MARK = "|"


def word_bpe(path: str | None = None) -> Callable[[list[str]], list[list[int]]]:
    """Token ids of texts, by the vocabulary file at ``path``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(path))
    return lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


def ends_at_blanks(path: str) -> bool:
    """Whether no token of this vocabulary spans a blank and none depends on what stands beyond one: a splitting that drops
    all white space comes first, and what normalizes before it leaves blanks where they are."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    before = (spec.get("normalizer") or {}).get("normalizers") or []
    # fixed values of the vocabulary file
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    first = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
    plain = all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for n in before)
    own = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not set(" \t\n\r") & set(t["content"]) for t in spec.get("added_tokens") or [])
    return steps[0] == first and plain and own and not spec.get("truncation") and not spec.get("padding")


#: Fixed values of the vocabulary file: the end of a word, and pieces of a word in ASCII and western letters, which neither
#: have other forms nor join with each other.
WORD_END = "</w>"
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
WESTERN = re.compile("[!-~À-ÖØ-öø-ÿ]*+")


def merger(path: str) -> Callable[[str], list[int]] | None:
    """Ids of a piece by the vocabulary's merges, applied by rank, or None where ids don't follow the merges' order.

    A byte no text has stands for the end of a word; a character with it is a token of its own, so it joins first.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or model.get("continuing_subword_prefix") or model.get("dropout"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte_of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    end = b"\xff"
    raw = lambda t: bytes(byte_of[c] for c in t.removesuffix(WORD_END)) + (end if t.endswith(WORD_END) else b"")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    try:
        single = {raw(t): i for t, i in model["vocab"].items() if len(t.removesuffix(WORD_END)) == 1}
        ranks = dict(single) | {raw(a + b): model["vocab"][a + b] for a, b in pairs}
    except KeyError:
        return None
    order = [model["vocab"][a + b] for a, b in pairs]
    if order != sorted(order) or order[0] <= max(single.values()) or len(set(ranks.values())) != len(ranks) or any(bytes([c]) not in single or bytes([c]) + end not in single for c in range(33, 255)):
        return None
    ranks.setdefault(end, max(ranks.values()) + 1)
    for c in range(256):  # bytes that the vocabulary doesn't have occur in no piece that is encoded here
        ranks.setdefault(bytes([c]), len(ranks) + (1 << 20))
    made = tiktoken.Encoding("merges", pat_str=".", mergeable_ranks=ranks, special_tokens={})
    short: dict[str, list[int]] = {}  # pieces of up to three characters

    def ids(piece: str) -> list[int]:
        if len(piece) > 3:
            return core(piece.encode() + end)
        if piece not in short:
            short[piece] = core(piece.encode() + end)
        return short[piece]

    core = made._core_bpe.encode_single_piece
    return ids


@lru_cache(1)  # a worker keeps what it knows from task to task
def encoder(path: str | None = None, held: int = HELD) -> Callable[[list[str]], list[bytes]]:
    """Little-endian token ids of texts: a word between blanks is encoded once and remembered, where the vocabulary allows.
    Words in western letters are cut into pieces and merged here; all others go through the tokenizer."""
    encode = word_bpe(path)
    if not ends_at_blanks(vocabulary(path)):
        return lambda texts: [np.array(ids, "<u4").tobytes() for ids in encode(texts)]
    known: dict[str, bytes] = {}
    old: dict[str, bytes] = {}
    tokens, (bar,), merge = 0, encode([MARK])[0], merger(vocabulary(path))
    if merge is not None and any([i for p in PIECES.findall(t.lower()) for i in merge(p)] != encode([t])[0] for t in ("Don't", "a1b22", "x--y!?", "internationalization", "'S'Ll", "zq#%9", "Übergrößenträger", "ÿÀé's")):
        merge = None

    def run(texts: list[str]) -> list[bytes]:
        nonlocal tokens, known, old
        words = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if tokens > held:  # words that come again move on from the older half
            known, old, tokens = {}, known, 0
        new = set().union(*words) - known.keys()
        again = new & old.keys()
        known.update((w, old[w]) for w in again)
        new -= again
        if merge is not None:
            for w in [w for w in new if WESTERN.fullmatch(w) and "<|" not in w]:
                ids = [i for p in PIECES.findall(w.lower()) for i in merge(p)]
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
                tokens += len(ids)
                new.discard(w)
        own = [w for w in new if MARK in w]
        rest = list(new.difference(own))
        for word, ids in zip(own, encode(own) if own else (), strict=True):
            known[word] = np.array(ids, "<u4").tobytes()
        if rest:  # one text for all of them: the mark is one token that no word without it has
            ids = np.array(encode([f" {MARK} ".join(rest)])[0], "<u4")
            ends = [*(4 * np.flatnonzero(ids == bar)).tolist(), 4 * len(ids)]
            data, at = ids.tobytes(), 0
            for word, end in zip(rest, ends, strict=True):
                known[word] = data[at:end]
                at = end + 4
            tokens += len(ids)
        tokens += len(again) + len(own)
        return [b"".join([known[w] for w in line]) for line in words]

    return run


holds("packing", encoder.cache_clear)
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"


def pieces(df: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored pieces of every document, each ranked among those of its length in its partition."""
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("part", pa.int32()), ("rank", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        settle("packing")
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (size + 1)
        for docs, texts in each_text(batches, AT_ONCE):
            out = [[] for _ in schema]
            for doc, ids in zip(docs, encode([t or "" for t in texts]), strict=True):
                packed = ids + END.to_bytes(4, "little")
                for at in range(0, len(packed), 4 * size):
                    cut = packed[at : at + 4 * size]
                    n = len(cut) // 4
                    row = (doc, at // 4, n, zlib.crc32(cut), len(packed) // 4, part, seen[n])
                    seen[n] += 1
                    for column, value in zip(out, (*row, np.frombuffer(cut, "<i4")) if with_ids else row, strict=True):
                        column.append(value)
            yield rows(schema, *out)

    return stored(two_columns(df, id_col, text_col).mapInArrow(run, PIECE + (", ids array<int>" if with_ids else "")), "pieces")


def fill(left: dict[int, int], size: int) -> dict[int, int]:
    """The multiset of the lengths left, the longest among them, whose sum comes closest to ``size``."""
    lengths = sorted((n for n, c in left.items() if c), reverse=True)
    mask, first = (1 << size + 1) - 1, lengths[0]
    reach, trail = 1 << first, []
    for n in lengths:
        if reach >> size & 1:
            break
        have, before, bundle = min(left[n] - (n == first), size // n), reach, 1
        while have > 0:  # bundles of 1, 2, 4, ... and the rest give every count up to have
            take = min(bundle, have)
            reach |= reach << take * n & mask
            have, bundle = have - take, bundle * 2
        if reach != before:
            trail.append((n, before))
    total = size if reach >> size & 1 else reach.bit_length() - 1
    counts: dict[int, int] = {}
    for n, before in reversed(trail):
        while not before >> total & 1:
            counts[n] = counts.get(n, 0) + 1
            total -= n
    counts[first] = counts.get(first, 0) + 1
    return counts


def plan(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows (length, first rank, ranks, pieces to a sequence, first sequence, offset), by length, then first rank."""
    left, used, out, sequence = {n: c for n, c in histogram.items() if c}, dict.fromkeys(histogram, 0), [], 0
    while left:
        counts = fill(left, size)
        times, offset = min(left[n] // c for n, c in counts.items()), 0
        for n, c in sorted(counts.items(), reverse=True):
            out.append((n, used[n], times * c, c, sequence, offset))
            used[n] += times * c
            left[n] -= times * c
            if not left[n]:
                del left[n]
            offset += c * n
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack(df: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: where it starts in its document and where it lies in its sequence; ``with_ids`` its tokens too."""
    cut = pieces(df, size, path, with_ids, id_col, text_col)
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    made = plan(histogram, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = cut.join(shifts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("shift"))
    wide = int(made[:, 1:3].sum(1).max()) + 1 if len(made) else 1
    starts = made[:, 0] * wide + made[:, 1]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"] + (["ids"] if with_ids else [])

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            row = made[np.searchsorted(starts, length * wide + rank, side="right") - 1]
            k = rank - row[:, 1]
            own = [b.column(n) for n in names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(row[:, 4] + k // row[:, 3]), pa.array(row[:, 5] + k % row[:, 3] * length)], [*(n for n in names if n != "rank"), "sequence_id", "offset"])

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + ("ids array<int>, " if with_ids else "") + "sequence_id long, offset long"
    return ranked.select(*names).mapInArrow(place, kind)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
