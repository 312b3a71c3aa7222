import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.suffix_dedup import Unit, dedup, kasai, suffix_order, words8


def brute(docs, length):
    least = {}
    for doc, text in docs:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            least[raw[k : k + length]] = min(least.get(raw[k : k + length], 1 << 63), doc)
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if least[raw[k : k + length]] < doc:
                gone[k : k + length] = True
        spans = sum(bool(gone[k]) and not (k and gone[k - 1]) for k in range(len(raw)))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cases():
    rng = np.random.default_rng(1)
    passage = "".join(rng.choice(list("abcdé "), 300))
    docs = [(k, "".join(rng.choice(list("abcdefgh "), rng.integers(0, 400)))) for k in range(60)]
    docs = [(k, t[:50] + passage[k : k + 200] + t[50:] if k % 3 == 0 else t) for k, t in docs]
    return [*docs, (60, None), (61, ""), (62, "ab" * 400), (63, "ab" * 300), (64, docs[5][1]), (64, docs[5][1]), (65, passage)]


@pytest.mark.parametrize(("size", "shard"), [(500, 200), (4000, 64), (1 << 20, 3000)])
def test_equals_brute_force_over_many_units_and_shards(spark, size, shard):
    docs = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in dedup(df, size=size, shard=shard).collect()), key=repr) == sorted(brute(docs, 50), key=repr)


def test_null_and_negative_ids(spark):
    docs = [(None, "x" * 70), (-1, "x" * 60), (-5, "y" * 80 + "x" * 55), (None, "y" * 60), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in dedup(df).collect())
    assert got == [(False, -5, 135, 0, 0), (False, -1, 60, 60, 1), (False, 3, 0, 0, 0), (True, 0, 60, 60, 1), (True, 0, 70, 70, 1)]


def test_spans_and_kept_bytes(spark):
    df = spark.createDataFrame([(1, "a" * 20 + "b" * 60), (2, "c" * 10 + "b" * 55 + "d" * 5)], "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], bytes(r["kept"])) for r in dedup(df, with_text=True).collect()}
    assert got == {1: ([], b"a" * 20 + b"b" * 60), 2: ([[10, 65]], b"c" * 10 + b"d" * 5)}


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 60, 5), (2, "x" * 60, 6)], "doc_id long, text string, shard long")
    assert sorted((r["doc_id"], r["n_removed"]) for r in dedup(df).collect()) == [(1, 0), (2, 60)]
    assert dedup(df.limit(0)).collect() == []


def check(texts, shard):
    u = Unit(list(range(len(texts))), [t.encode() for t in texts], 50, shard)
    for s in u.shards():
        found = dict(zip(*(x.tolist() for x in s.local()), strict=True))
        valid = np.flatnonzero(s.valid).tolist()
        assert valid == [p for p in range(s.n) if any(a <= p + s.at and p + s.at + 50 <= e for a, e in zip(u.starts, u.starts[1:]))]
        of = {}
        for p in valid:
            of.setdefault(u.bytes[s.at + p : s.at + p + 50], []).append(p)
        want = {p: min(s.doc(np.array(same)).tolist()) for same in of.values() if len(same) > 1 for p in same}
        assert found == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=150), max_size=8), st.sampled_from([40, 130, 4000]))
def test_classes_inside_a_shard(texts, shard):
    check(texts, shard)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.text("ab", max_size=20)), max_size=10), st.sampled_from([70, 4000]))
def test_classes_that_part_late(parts, shard):
    """Strings that share their first 40 bytes and part afterwards."""
    check(["x" * 40 + "abcd"[i] + "yz" * 5 + "abcd"[j] + t for i, j, t in parts], shard)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["abc" * 30, "ab" * 40, "x", "abcabd" * 12, "q" * 70]), max_size=12))
def test_kasai_equals_plain_comparison(parts):
    data = "".join(parts).encode() + b"\0"
    padded, n = data + b"\xff" * 300, len(data)
    w = words8(padded, 0, n + 128)
    order, rank = suffix_order(w, n, 64)
    got = kasai(w, n, order, rank, 64).tolist() if len(order) else []
    for k in range(1, len(order)):
        a, b = padded[order[k - 1] : order[k - 1] + 64], padded[order[k] : order[k] + 64]
        shared = next((i for i in range(64) if a[i] != b[i]), 64)
        assert got[k] == shared or max(order[k - 1], order[k]) + 64 > n and min(got[k], shared) >= n - max(order[k - 1], order[k])
