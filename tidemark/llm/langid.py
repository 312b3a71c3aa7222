"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text, lower-cased, gives its byte n-grams (3 and 4 bytes, word ends included); each is hashed to a row of an embedding
table, a text's vector is the mean of its rows, and a linear softmax names the language. Tables and softmax are trained
together by stochastic gradient descent in numpy on short windows of a bounded sample: of the ``most`` commonest languages
the ``per_lang`` texts with the smallest hashes. Temperature scaling on documents set aside calibrates the score; a
prediction whose score is under the threshold that keeps 99 % of the right ones there is marked as rejected.

As the softmax is linear, tables and weights are multiplied once, and a prediction sums rows of logits: whole texts, in
blocks of bounded memory.

Defined cases: a text that is null or has no letter (of Unicode's categories L) gives ``und`` with score 0; without any
labelled document every prediction is ``und``; of languages that score alike the first by name is taken; repeated rows each
get their own prediction; a null doc_id is not held out; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, rows, two_columns

LETTER = regex.compile(r"\p{L}")
BITS = 14
SIZES = (3, 4)
#: ASCII other than letters becomes a blank.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
BLOCK = 1 << 17


def text_bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(PLAIN) + b" "


def gram_rows(data: np.ndarray, n: int) -> np.ndarray:
    """The table row of the n-gram that starts at each byte; the sizes have tables of their own."""
    h = data[: len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h ^= data[k : len(data) - n + 1 + k]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int32) + np.int32(SIZES.index(n) << BITS)


def all_rows(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return np.concatenate([gram_rows(a, n) for n in SIZES if len(a) >= n])


class Model:
    """The languages, a table of logits for each subword row, the bias and the calibration."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, heat: float, least: float):
        self.langs, self.logits, self.bias, self.heat, self.least = langs, logits, bias, heat, least

    def raw(self, data: bytes) -> np.ndarray:
        """Mean logits of a text, summed in blocks that overlap by the longest n-gram less one byte."""
        a, total, n = np.frombuffer(data, np.uint8), np.zeros(len(self.langs)), 0
        for size in SIZES:
            for at in range(0, len(a) - size + 1, BLOCK):
                got = np.bincount(gram_rows(a[at : at + BLOCK + size - 1], size), minlength=len(self.logits))
                total += got @ self.logits
                n += int(got.sum())
        return total / max(1, n) + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        many = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        scores = self.batch([text_bytes(texts[k]) for k in many]) if self.langs and many else []
        by = dict(zip(many, scores, strict=False))
        for k in range(len(texts)):
            if k not in by:
                out.append(("und", 0.0, True))
                continue
            z = by[k] / self.heat
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            out.append((self.langs[best], float(p[best]), bool(p[best] < self.least)))
        return out

    def batch(self, parts: list[bytes]) -> np.ndarray:
        """Mean logits of many texts at once; long ones alone."""
        out = np.zeros((len(parts), len(self.langs)))
        group: list[int] = []
        size = 0
        for k in range(len(parts) + 1):
            if group and (k == len(parts) or size + len(parts[k]) > BLOCK):
                out[group] = self.joined([parts[i] for i in group])
                group, size = [], 0
            if k < len(parts):
                if len(parts[k]) > BLOCK:
                    out[k] = self.raw(parts[k])
                else:
                    group.append(k)
                    size += len(parts[k])
        return out

    def joined(self, parts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(p) for p in parts])
        starts = np.concatenate(([0], lengths.cumsum()[:-1]))
        a = np.frombuffer(b"".join(parts), np.uint8)
        total, count = np.zeros((len(parts), len(self.langs))), np.zeros(len(parts))
        for n in SIZES:
            if len(a) < n:
                continue
            got = self.logits[gram_rows(a, n)]
            for k in range(1, n):  # n-grams that reach into the next text don't count
                ends = starts + lengths - k
                got[ends[(ends >= 0) & (ends < len(got)) & (ends >= starts)]] = 0
            full = np.zeros((len(a), got.shape[1]), got.dtype)
            full[: len(got)] = got
            total += np.add.reduceat(full, starts, axis=0)
            count += np.maximum(0, lengths - n + 1)
        return total / np.maximum(1, count)[:, None] + self.bias


def train(windows: list[tuple[str, int, bytes]], width: int = 16, epochs: int = 6, rate: float = 0.5, batch: int = 64, seed: int = 11) -> Model:
    """Learn from windows (language, document, bytes); those of a fifth of the documents only calibrate."""
    langs = sorted({w[0] for w in windows})
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros(0), 1.0, 0.0)
    r = np.random.default_rng(seed)
    docs, of = np.unique([w[1] for w in windows], return_inverse=True)
    aside = np.isin(of, r.permutation(len(docs))[: len(docs) // 5])
    if aside.all() or len({w[0] for w, a in zip(windows, aside, strict=True) if not a}) < len(langs):
        aside[:] = False
    held, used = np.flatnonzero(aside), r.permutation(np.flatnonzero(~aside))
    windows = [(w[0], w[2]) for w in windows]
    y = np.array([langs.index(lang) for lang, _ in windows])
    ids = [all_rows(data) for _, data in windows]
    table = r.normal(0, 0.1, (len(SIZES) << BITS, width)).astype(np.float32)
    weight, bias = r.normal(0, 0.1, (width, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    share = np.bincount(y, minlength=len(langs)) / len(y)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        r.shuffle(used)
        for at in range(0, len(used), batch):
            mine = used[at : at + batch]
            flat, n = np.concatenate([ids[k] for k in mine]), np.array([len(ids[k]) for k in mine])
            mean = np.add.reduceat(table[flat], np.concatenate(([0], n.cumsum()[:-1])), axis=0) / n[:, None]
            z = mean @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(mine)), y[mine]] -= 1
            p /= (share[y[mine]] * len(langs))[:, None]  # rare languages count as much as common ones
            back = p @ weight.T * (step * 20 / n)[:, None]
            weight -= step * mean.T @ p / len(mine) * 10
            bias -= step * p.mean(0)
            np.subtract.at(table, flat, np.repeat(back.astype(np.float32), n, axis=0))
    model = Model(langs, (table @ weight).astype(np.float32), bias, 1.0, 0.0)
    if len(held) >= 20:
        z = np.array([model.raw(windows[k][1]) for k in held])
        loss = lambda t: -np.mean((z / t)[np.arange(len(held)), y[held]] - np.log(np.exp(z / t - (z / t).max(1, keepdims=True)).sum(1)) - (z / t).max(1))
        model.heat = float(min(np.geomspace(0.05, 20, 80), key=loss))
        p = np.exp(z / model.heat - (z / model.heat).max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True)).max(1)
        right = z.argmax(1) == y[held]
        model.least = float(np.quantile(p[right], 0.01)) if right.any() else 0.0
    return model


def cut_windows(text: str, most: int = 6, words: int = 24) -> list[bytes]:
    """Up to ``most`` windows of ``words`` words, spread evenly over the whole text."""
    split = text.split()
    if not split:
        return []
    starts = sorted({int(k * max(0, len(split) - words) / max(1, most - 1)) for k in range(most)})
    return [text_bytes(" ".join(split[s : s + words])) for s in starts]


def fit(docs: DataFrame, per_lang: int = 400, most: int = 200) -> Model:
    """Train on at most ``per_lang`` texts of each of the ``most`` commonest languages; docs: text, lang.

    A language's texts are taken below a bound on their hashes, set from its count so that half as many again as wanted are
    expected; copies of a text count once. So no task gathers a language.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not counts:
        return train([])
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min((1 << 63) - 1, (1 << 63) * 3 * per_lang // (2 * r["n"]))) for r in counts], "lang string, bound long")
    near = known.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1)).join(F.broadcast(bounds), "lang").filter("h <= bound")
    sample = near.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            for lang, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if LETTER.search(text):
                    got = cut_windows(text)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array([h] * len(got), pa.int64()), pa.array(got, pa.binary())], ["lang", "h", "data"])

    got = sample.select("lang", "h", "text").mapInArrow(run, "lang string, h long, data binary").collect()
    first = {(lang, h) for lang in {r["lang"] for r in got} for h in sorted({r["h"] for r in got if r["lang"] == lang})[:per_lang]}
    return train(sorted((r["lang"], r["h"], bytes(r["data"])) for r in got if (r["lang"], r["h"]) in first))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected; a narrow pass over whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by BITS and the number of languages

    def run(batches):
        for ids, texts in each_text(batches):
            got = sent.value.predict(texts)
            yield rows(schema, ids, *([g[k] for g in got] for k in range(3)))

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    out = predict(docs, fit(docs.filter(F.coalesce(fold(F.col("doc_id")) != 2, F.lit(False)))))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
