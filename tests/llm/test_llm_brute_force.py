"""Operators that SQL can't express, held against plain versions; awkward rows; clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import ann, decontam, langid, near_copies, packing, pii, quality, secrets, simhash, suffix_dedup, url_reputation

SF = "/root/testdata/sf0.01"


def spelled(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_pii(text):
    """The four patterns of the contract as they stand, filtered afterwards."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def plain_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


PIECES = st.sampled_from(["a.b@c-d.org", "@", "x@y", "1.2.3.4", "256.1.1.1", "0" * 400 + "1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-0199", "+", "..", " ", "-", "é", "\n", "7", "Password = 'abcdefgh1'", "api_key:", "AKIA" + "A1" * 8, "deadbeef" * 5, "token=short", "x" * 20, "ab12", "\u212a", "\u017fecret: longenough1"])
TEXTS = st.lists(st.one_of(PIECES, st.text(max_size=4)), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_base_spans_equal_plain_patterns(text):
    assert [s[:3] for s in pii.spans_of(text) if s[3]] == plain_pii(text)
    assert [s[:3] for s in secrets.spans_of(text) if s[3]] == plain_secrets(text)


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op2_pii", plain_pii, ("email", "ip", "card", "phone")), ("op10_secrets", plain_secrets, ("assign", "access", "hex"))])
def test_digests_equal_plain_patterns_on_all_documents(spark, name, plain, kinds):
    from tidemark.llm import queries

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spelled(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in want) for k in kinds]
        assert {spelled([w]) for w in want} <= set(r["spans"].split(","))


def test_added_spans_do_not_overlap_and_long_candidates_are_proposed():
    text = "ip 1.2.3.4, " * 6 + "mail " + "a" * 90 + " (at) " + ".".join(["sub"] * 9) + " (dot) org, iban DE89370400440532013000 call 0555 010 0199"
    spans = sorted(s[1:3] for s in pii.spans_of(text))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert any(e - s > 90 for _, s, e in pii.candidates(text.encode()))


def test_private_keys_only():
    n = b"\x02\x40" + bytes(range(1, 65))
    seq = lambda *parts: b"\x30" + (bytes([len(b"".join(parts))]) if len(b"".join(parts)) < 128 else b"\x81" + bytes([len(b"".join(parts))])) + b"".join(parts)
    private, public = seq(b"\x02\x01\x00", n, b"\x02\x01\x03"), seq(n, b"\x02\x01\x03")
    certificate, boxed = seq(seq(n), seq(b"\x06\x01\x2a"), b"\x03\x02\x00\x01"), seq(b"\x02\x01\x00", seq(b"\x06\x01\x2a"), b"\x04\x20" + bytes(32))
    ssh = b"\0\0\0\x07ssh-rsa\0\0\0\x03\1\0\1\0\0\0\x20" + bytes(32)
    assert [secrets.key_der(x) for x in (private, boxed, public, certificate, private[:-1])] == [True, True, False, False, False]
    for blob, want in ((private, 1), (public, 0), (ssh, 0), (certificate, 0)):
        assert len([s for s in secrets.spans_of("key " + base64.b64encode(blob).decode() + " end") if not s[3]]) == want
    deep = b"\x30\x00"
    while len(deep) < 60_000:
        size = len(deep)
        deep = b"\x30" + (bytes([size]) if size < 128 else bytes([0x80 + (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")) + deep
    assert secrets.elements(deep) is not None


# quality and language: scores recomputed by plain loops from the learned weights -------------------------------------------


def test_quality_equals_a_plain_sum(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, quality.graded(spark.read.parquet(f"{SF}/labels.parquet")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    mask = (1 << quality.BITS) - 1
    for r in quality.score(docs, model).collect():
        words, z, first = (texts[r["doc_id"]] or "").encode().split(), 0.0, {}
        for k, w in enumerate(words):
            first[zlib.crc32(w.lower().strip(quality.EDGE)) & mask] = 1.0
        for k, w in enumerate(words):
            form = zlib.crc32(re.sub(rb"(.)\1+", rb"\1", w.translate(quality.FORM)), 7) & mask
            first[form] = first.get(form, 0) + 4 / len(words)
            if k and words[k - 1] == w:
                first[quality.AGAIN] = first.get(quality.AGAIN, 0) + 4 / len(words)
        z = sum(float(model.weights[i]) * v for i, v in first.items())
        tails = [1 / (1 + np.exp(-(z - t))) for t in model.thresholds]
        assert abs(r["expected_grade"] - sum(tails)) < 1e-3 and abs(r["tail"] - tails[1]) < 1e-3


def test_selected_rows_are_those_kept(spark):
    docs, rated = spark.read.parquet(f"{SF}/documents.parquet"), quality.graded(spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score(docs, quality.fit(docs, rated)).collect() if r["keep"]}
    chosen = quality.select(docs, rated)
    assert chosen.columns == docs.columns and sorted(r["doc_id"] for r in chosen.collect()) == sorted(kept)


def test_language_equals_a_plain_mean(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    texts = {r["doc_id"]: r["text"] for r in docs.limit(60).collect()}
    got = {r["doc_id"]: r for r in langid.predict(docs.limit(60), model).collect()}
    for doc, text in texts.items():
        data = langid.text_bytes(text)
        z, n = np.zeros(len(model.langs)), 0
        for size in langid.SIZES:
            for at in range(len(data) - size + 1):
                h = data[at]
                for c in data[at + 1 : at + size]:
                    h = h * 0x01000193 % (1 << 32) ^ c
                h = h * 0x9E3779B1 % (1 << 32)
                z += model.logits[(h >> 32 - langid.BITS) + (langid.SIZES.index(size) << langid.BITS)]
                n += 1
        z = (z / n + model.bias) / model.heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[doc]["lang_pred"] == model.langs[int(p.argmax())] and abs(got[doc]["score"] - p.max()) < 1e-4


def test_texts_without_letters_have_no_language():
    model = langid.train([(lang, k, langid.text_bytes(t)) for k in range(20) for lang, t in (("a", "the quick fox"), ("b", "der schnelle fuchs"))])
    got = model.predict(["½ ² Ⅷ ② 123 _", "中", "", None, "the fox"])
    assert [g[0] for g in got[:1] + got[2:4]] == ["und"] * 3 and got[1][0] != "und" and got[4][0] == "a"


# proximity search ---------------------------------------------------------------------------------------------------------------


def test_proximity_equals_brute_force(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40)))) for k in range(40)]
    items = spark.createDataFrame([(1, "a b"), (2, "c g e")], "item_id long, text string")
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["doc_id"]: set(r["items"]) for r in decontam.search(index, items, slop=2).collect()}
    for doc, text in docs:
        words, want = text.split(), set()
        for item, terms in ((1, "ab"), (2, "cge")):
            counts = {t: sum(d[1].split().count(t) for d in docs) for t in terms}
            rare = min(terms, key=lambda t: (counts[t], terms.index(t)))
            for p in [p for p, w in enumerate(words) if w == rare]:
                if all(any(w == t and abs(q - p) <= 2 for q, w in enumerate(words)) for t in terms):
                    want.add(item)
        assert got.get(doc, set()) == want


# awkward rows: null and empty texts, repeated and null ids, long texts, a clashing column -----------------------------------------

LONG = "word " * 30_000
ROWS = [(1, None, 0), (2, "", 0), (3, "a b", 1), (3, "a b", 1), (3, "unlike text", 1), (None, "x y z", 2), (4, LONG, 3)]


def docs_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, part int")


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


EVERY = sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("run", [pii.find_pii, pii.redact, secrets.find_secrets, simhash.near_duplicates, near_copies.near_copies, suffix_dedup.dedup, lambda d: quality.score(d, None), lambda d: langid.predict(d, langid.train([])), lambda d: decontam.contamination(d, d.select(d["doc_id"].alias("item_id"), "text").limit(0))])
def test_every_row_gets_a_result(spark, run):
    assert ids(run(docs_of(spark))) == EVERY
    assert run(docs_of(spark).limit(0)).count() == 0


def test_packing_awkward_rows(spark):
    got = packing.pack(docs_of(spark)).collect()
    assert sorted({(r["doc_id"], r["doc_tokens"]) for r in got}, key=repr) == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (3, 3), (None, 4), (4, 30_001)][:3] + [(None, 4), (4, 30_001)], key=repr)
    assert sum(r["length"] for r in got) == 1 + 1 + 3 * 3 + 4 + 30_001
    assert packing.pack(docs_of(spark).limit(0)).count() == 0


def test_dropping_goes_by_row(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    df = docs_of(spark)
    kept = pipeline.near_duplicates(spark, df, SF)
    assert kept.columns == df.columns
    # null and empty texts have the same (empty) set of words; a repeated row stays once; unlike texts of one doc_id stay
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == [(1, None), (3, "a b"), (3, "unlike text"), (4, LONG)]
    assert pipeline.near_duplicates(spark, df.limit(0), SF).count() == 0
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leaks = docs_of(spark, [*ROWS, (3, item, 9), (None, item, 9)])
    assert ids(pipeline.decontaminate(spark, leaks, SF)) == EVERY
    assert pipeline.decontaminate(spark, leaks.limit(0), SF).count() == 0
    graded = pipeline.grade(spark, df, SF)  # no label fits: learned from nothing, everything stays
    assert graded.columns == df.columns and graded.count() <= len(ROWS)
    assert ids(pipeline.redact(spark, df, SF)) == EVERY and pipeline.redact(spark, df, SF).columns == df.columns


def test_columns_with_names_used_inside(spark):
    df = docs_of(spark).selectExpr("doc_id", "text", "part AS node", "part AS rid", "part AS th", "part AS key", "part AS component", "part AS fp", "part AS keys", "part AS many", "part AS shared")
    assert near_copies.drop_near_copies(df).columns == df.columns and near_copies.drop_near_copies(df).count() == 5
    assert simhash.near_duplicates(df).count() == len(ROWS)


def test_urls_awkward_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "http://A.com/x"), (3, "no scheme"), (4, "ftp://" + "h" * 50_000 + ".net/es/?q"), (5, "http://net/fr/"), (6, "x://www.EXAMPLE.com/en/a?b#c")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "1 AS host", "2 AS rule")
    got = sorted(((r["page_id"], len(r["host"]), r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge(df).collect()), key=repr)
    assert got == sorted([(1, 0, "", None, "allow")] * 2 + [(2, 0, "", None, "allow"), (None, 5, "/x", "com/", "allow"), (3, 0, "", None, "allow"), (4, 50_004, "/es/", "net/es/", "block"), (5, 3, "/fr/", "net/fr/", "block"), (6, 15, "/en/a", "www.example.com/en/", "allow")], key=repr)
    assert url_reputation.judge(df.limit(0)).count() == 0


def test_nearest_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0]), (None, [1.0, 1.0])]
    df = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index, model = ann.build(df)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(index, model, ann.members(index, df.filter("vec_id = 0"))).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 2, 0.8), (0, 2, 0, 0.0), (0, 2, 2, 0.6), (0, 3, 0, 0.0), (0, 3, 1, 0.0)]
    assert ann.search(*ann.build(df.limit(0)), df.limit(0).selectExpr("1L AS id", "*")).count() == 0


# the whole pipeline ----------------------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_hand(spark):
    """Each stage's rows, from plain versions of what it decides, on small documents."""
    pipeline = pytest.importorskip("corpus_pipeline")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.score(source, quality.fit(source, quality.graded(spark.read.parquet(f"{SF}/labels.parquet")))).collect() if r["keep"]}
    texts = {r["doc_id"]: r["text"] or "" for r in source.collect() if r["doc_id"] in kept}
    sets = {}
    for d, t in texts.items():
        words = t.encode().lower().split()
        sets[d] = frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    by: dict = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for d in sorted(sets):
        for o in {o for g in sets[d] for o in by[g] if o > d}:
            if 5 * len(sets[d] & sets[o]) >= 4 * len(sets[d] | sets[o]):
                a, b = sorted((find(d), find(o)))
                top[b] = a
    texts = {d: t for d, t in texts.items() if find(d) == d}
    word = re.compile("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+")
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(lower(r["text"] or ""))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = {}
    for d, t in texts.items():
        w = word.findall(lower(t))
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean[d] = t
    model, encode, want = pii.trained(), packing.word_bpe(), {}
    for d, t in clean.items():
        out, last = [], 0
        for kind, s, e, *_ in sorted(pii.spans_of(t, model), key=lambda x: (x[1], -x[2])):
            if s >= last:
                out += [t[last:s], f"[{kind.upper()}]"]
            last = max(last, e)
        want[d] = [*encode(["".join([*out, t[last:]])])[0], 1]
    got: dict = {}
    for r in pipeline.run(spark, SF).collect():
        got.setdefault(r["doc_id"], {})[r["start"]] = list(r["ids"])
    assert {d: sum((v[s] for s in sorted(v)), []) for d, v in got.items()} == want
