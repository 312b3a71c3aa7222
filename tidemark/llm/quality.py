"""Quality grades by ordinal cumulative-link regression.

A document's grade y in 0..K-1 follows P(y > k) = sigmoid(w.x - t_k) with one weight vector w over hashed words and
forms of words, and ordered thresholds t_0 < t_1 < ... (kept ordered by learning the logarithms of their gaps). Scoring gives the
expected grade and the tail probability P(y >= least), by which documents are selected.

Training is mini-batch gradient descent in numpy on a bounded sample of labelled rows: the ``most`` rows of each grade with
the smallest hashes of their ids. Everything else runs over whole texts of all rows.

Defined cases: null and empty texts have no features and get the grade of the bias alone, they are kept unless that falls
below the cut; repeated rows are scored each for itself; labels without a document or grade are ignored; of contradicting
labels of a document the lowest grade holds; with one grade or none to learn from, every document is kept with tail 1; texts
are read whole, whatever their length; an empty table gives no rows; other columns are not read (``select`` returns them as
they are), whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_text, holds, rows, settle, two_columns

BITS = 22
#: Labelled rows of each grade that are learned from, and rows that must share a feature for it to count.
MOST, SHARED = 1500, 8
#: The form of a word: capitals, small letters, digits; all other bytes stand for themselves.
FORM = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256))
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
RUNS = re.compile(rb"(.)\1+")
AGAIN = 1  # the feature of words that repeat the word before


@lru_cache(1 << 16)
def word_features(w: bytes) -> tuple[int, int]:
    """Numbers of a word as such, folded and without its edges, and of its form."""
    mask = (1 << BITS) - 1
    return crc32(w.lower().strip(EDGE)) & mask, crc32(RUNS.sub(rb"\1", w.translate(FORM)), 7) & mask


holds("quality", word_features.cache_clear)


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights of a whole text: words count by presence, forms and repeats by their share."""
    words = text.encode("utf-8", "replace").split() if text else []
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    got: dict[int, float] = {}
    shares: dict[int, int] = {AGAIN: sum(map(bytes.__eq__, words, words[1:]))}
    for w, n in Counter(words).items():
        word, form = word_features(w)
        got[word] = 1.0
        shares[form] = shares.get(form, 0) + n
    for form, n in shares.items():
        got[form] = got.get(form, 0) + 4 * n / len(words)
    index = np.fromiter(got, np.int32, len(got))
    order = np.argsort(index)
    return index[order], np.fromiter(got.values(), np.float32, len(got))[order]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Ordinal:
    def __init__(self, grades: int):
        self.weights, self.first, self.gaps = np.zeros(1 << BITS, np.float32), -0.5, np.zeros(max(0, grades - 2))

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate(([0.0], np.cumsum(np.exp(self.gaps))))

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(y > k) for each k."""
        return sigmoid(z[:, None] - self.thresholds)

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(self.weights[index] @ value) if len(index) else 0.0

    def fit(self, xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, shared: int = SHARED, epochs: int = 40, rate: float = 0.3, sparse: float = 1e-3, seed: int = 5) -> Ordinal:
        """Adaptive proximal gradient ascent on a likelihood balanced by the roots of the grades' shares, less ``sparse`` times the weights' sizes, over the features that ``shared`` rows have at least."""
        rng, k = np.random.default_rng(seed), len(self.gaps) + 1
        share = np.bincount(ys, minlength=k + 1)
        balance = np.where(share > 0, np.sqrt(len(ys) / (np.maximum(share, 1) * max(1, (share > 0).sum()))), 0)
        seen, rows_with = np.unique(np.concatenate([x[0] for x in xs]), return_counts=True)
        names = seen[rows_with >= shared]
        kept = []
        for index, value in xs:
            at = np.minimum(np.searchsorted(names, index), max(0, len(names) - 1))
            ok = names[at] == index if len(names) else np.zeros(len(index), bool)
            kept.append((at[ok], value[ok]))
        weights, squares, own = np.zeros(len(names)), np.full(len(names), 1e-2), np.full(k, 1.0)
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(ys)), max(1, len(ys) // 64)):
                index, value = (np.concatenate([kept[i][j] for i in some]) for j in (0, 1))
                owner = np.repeat(np.arange(len(some)), [len(kept[i][0]) for i in some])
                z, y, at = np.bincount(owner, weights[index] * value, len(some)), ys[some], np.arange(len(some))
                upper = np.column_stack((np.ones(len(some)), self.tails(z)))  # P(y >= k)
                lower = np.column_stack((upper[:, 1:], np.zeros(len(some))))
                a, b = upper[at, y], lower[at, y]
                mass, weight = np.maximum(a - b, 1e-9), balance[y] / len(some)
                da, db = a * (1 - a) / mass, b * (1 - b) / mass  # slopes of log(a - b) by the logits of a and b
                grad = np.bincount(index, ((da - db) * weight)[owner] * value, len(names))
                squares += grad * grad
                pace = rate / np.sqrt(squares)
                weights += pace * grad
                weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * sparse, 0)
                by = np.bincount(y[y > 0] - 1, -(da * weight)[y > 0], k) + np.bincount(y[y < k], (db * weight)[y < k], k)
                step = np.concatenate(([by.sum()], [by[j + 1 :].sum() * np.exp(g) for j, g in enumerate(self.gaps)]))
                own += step * step
                step = rate * step / np.sqrt(own)
                self.first, self.gaps = self.first + step[0], np.clip(self.gaps + step[1:], -4, 4)
        self.weights[names] = weights
        return self


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(labels["doc_id"].cast("long").alias("doc_id"), grade.alias("grade")).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """Learn from the ``most`` rated documents of each grade with the smallest hashes; ratings: doc_id, grade."""
    grades = [r["grade"] for r in ratings.select("grade").distinct().collect()]  # the scale of the ratings
    texts, parts = two_columns(docs, id_col, text_col), []
    for g in sorted(grades):
        chosen = ratings.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        parts += [(r["doc_id"], g) for r in chosen.select("doc_id").collect()]
    if len(grades) < 2:
        return None
    spark = docs.sparkSession
    wanted = spark.createDataFrame(parts, "doc_id long, grade int")
    schema = pa.schema([("grade", pa.int64()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches):
        settle("quality")
        for ids, some in each_text(batches):
            got = [hashed(t) for t in some]
            yield rows(schema, ids, [g[0] for g in got], [g[1] for g in got])

    # bounded: 3 * most rows, so it is sent to every executor
    sample = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select(F.col("grade").cast("long").alias("doc_id"), "text")
    got = sample.mapInArrow(run, "grade long, index array<int>, value array<float>").collect()
    if len({r["grade"] for r in got}) < 2:
        return None
    got.sort(key=lambda r: (r["grade"], len(r["index"]), r["index"]))
    xs = [(np.array(r["index"], np.int64), np.array(r["value"], np.float64)) for r in got]
    return Ordinal(max(grades) + 1).fit(xs, np.array([r["grade"] for r in got], np.int64))


def score(docs: DataFrame, model: Ordinal | None, least: int = 2, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail = P(grade >= least) and keep = tail >= cut of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.float64()), ("keep", pa.bool_())])

    def run(batches):
        settle("quality")
        own = sent.value
        for ids, texts in each_text(batches):
            if own is None:
                yield rows(schema, ids, [None] * len(ids), [1.0] * len(ids), [True] * len(ids))
                continue
            tails = own.tails(np.array([own.score(*hashed(t)) for t in texts]))
            tail = tails[:, least - 1]
            yield rows(schema, ids, tails.sum(1), tail, tail >= cut)

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, expected_grade double, tail double, keep boolean")


def select(docs: DataFrame, ratings: DataFrame, least: int = 2, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are good enough, each judged by its own text: a narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, ratings, id_col=id_col, text_col=text_col))  # 2^BITS weights
    at = docs.columns.index(text_col)

    def run(batches):
        settle("quality")
        own = sent.value
        for b in batches:
            if own is not None and b.num_rows:
                step = max(1, int(b.num_rows * (8 << 20) / max(1, b.nbytes)))
                texts = (t for k in range(0, b.num_rows, step) for t in b.column(at).slice(k, step).to_pylist())
                b = b.filter(pa.array(own.tails(np.array([own.score(*hashed(t)) for t in texts]))[:, least - 1] >= cut))
            yield b

    return docs.mapInArrow(run, docs.schema)


def rounded(c: str) -> Column:
    return F.round(c, 6).alias(c)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return score(docs, fit(docs, graded(labels))).select("doc_id", rounded("expected_grade"), rounded("tail"), "keep")
