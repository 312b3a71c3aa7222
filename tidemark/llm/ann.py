"""Nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional codeword from each of several codebooks. Codebooks are learned
on residuals of a bounded sample (k-means), codes are found by beam search over all codebooks. A query scores codes by
lookup tables (one inner product per codeword, summed per vector; ``distances`` adds the stored norms for that measure).

The stored index holds every vector in the cell of its nearest centre, cells cut into slices of bounded size, so a vector
that a third of all rows repeat fills many slices. A query asks the ``probes`` cells whose centres score best; queries are
dealt to cells in blocks and joined with the slices there, so nothing passes through the driver and no task holds a cell.
Of each slice the best ``k * again`` codes, with all rows that tie with the last of them (copies have equal codes), are
ranked again by exact inner products, ties by vec_id. ``exact=True`` asks every cell and ranks every row again.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; ties go to the smaller vec_id; with fewer candidates than ``k`` all are returned; rows that repeat a vec_id are
queries and candidates each for itself (a query leaves out its own row only); an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, rows, stored

BOOKS, WORDS, BEAM = 16, 64, 4
#: Centres of cells, and cells that a query asks: all of them, as vectors without clusters have near ones in every cell
#: (32 of 64 cells give a recall of 0.86 on 51,282 such vectors). Fewer save work where vectors do form clusters.
CELLS, PROBES = 64, 64
#: Vectors that codebooks and centres are learned from, rows in a slice, queries in a block.
SAMPLE, SLICE, BLOCK = 4096, 4096, 512
#: Candidates of a slice that are ranked again, for each neighbour wanted; rows that tie with the last come on top.
AGAIN = 10


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.filter("vec_id is not null and embedding is not null").filter(fine)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for j in range(len(centres)):
            if (mine := own == j).any():
                centres[j] = x[mine].mean(0)
    return centres


class Additive:
    """Codebooks (books, words, dimension) and the centres of cells."""

    def __init__(self, books: np.ndarray, beam: int = BEAM, centres: np.ndarray | None = None):
        self.books, self.beam, self.centres = books, beam, centres

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, cells: int = CELLS, seed: int = 3) -> Additive:
        rng, left, out = np.random.default_rng(seed), x.copy(), []
        for _ in range(books):
            centres = kmeans(left, words, rng)
            if len(centres) < words:
                centres = np.concatenate((centres, np.zeros((words - len(centres), x.shape[1]))))
            out.append(centres)
            codes = cls(np.array(out), beam).encode(x)
            left = x - cls(np.array(out), beam).decode(codes)
        return cls(np.array(out), beam, kmeans(x, cells, rng))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of the nearest centre."""
        return (x @ self.centres.T - (self.centres**2).sum(1) / 2).argmax(1)

    def asks(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """The cells each query asks: those whose centres score best, by their mean vectors' direction and size."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows, books): the beam keeps the combinations with the smallest residuals after each book."""
        n = len(x)
        codes, left = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
        for book in self.books:
            cost = (book**2).sum(1) - 2 * left @ book.T + (left**2).sum(2)[:, :, None]
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, word = np.divmod(best, len(book))
            row = np.arange(n)[:, None]
            codes = np.concatenate((codes[row, parent], word[:, :, None].astype(np.uint8)), axis=2)
            left = left[row, parent] - book[word]
        return codes[np.arange(n), (left**2).sum(2).argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, rows) from lookup tables."""
        tables = np.einsum("qd,mwd->mwq", queries, self.books).astype(np.float32)
        out = tables[0][codes[:, 0]]
        for m in range(1, len(tables)):
            out += tables[m][codes[:, m]]
        return out.T

    def distances(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate squared distances (queries, rows) from lookup tables and stored norms."""
        return (queries**2).sum(1)[:, None] - 2 * self.scores(queries, codes) + norms[None, :]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


SLICED = "cell int, n int, ids binary, vec_ids binary, codes binary, norms binary, vectors binary"


def build(vectors: DataFrame, sample: int = SAMPLE, books: int = BOOKS, words: int = WORDS, cells: int = CELLS, size: int = SLICE) -> tuple[DataFrame | None, Additive | None]:
    """The stored index over usable vectors (vec_id, embedding), in slices of cells, and its quantiser, learned from ``sample``."""
    width = vectors.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return None, None
    vectors = vectors.filter(F.size("embedding") == width["w"])
    some = vectors.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(sample).select("embedding").collect()
    model = Additive.fit(np.array([r["embedding"] for r in some]), books, words, cells=cells)
    coded = pa.schema([("id", pa.int64()), ("vec_id", pa.int64()), ("cell", pa.int32()), ("codes", pa.binary()), ("norm", pa.float64()), ("embedding", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = matrix(part.column(2))
                codes = model.encode(x)
                yield rows(coded, part.column(0), part.column(1), model.cells(x).astype(np.int32), [c.tobytes() for c in codes], (model.decode(codes) ** 2).sum(1), part.column(2))

    known = vectors.select(F.monotonically_increasing_id().alias("id"), "vec_id", "embedding")
    held = stored(known.mapInArrow(run, "id long, vec_id long, cell int, codes binary, norm double, embedding array<double>"), "vectors")
    many = {r["cell"]: -(-r["count"] // size) for r in held.groupBy("cell").count().collect()}  # a row for each cell
    out_of = F.element_at(F.create_map(*[F.lit(x) for c, n in sorted(many.items()) for x in (c, n)]), F.col("cell"))
    sliced = pa.schema([("cell", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("ids", "vec_ids", "codes", "norms", "vectors")])

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("id").to_numpy())
        take = lambda c: group.column(c).to_numpy()[order].tobytes()
        x = matrix(group.column("embedding").combine_chunks())[order]
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)[order]
        return pa.Table.from_batches([rows(sliced, [group.column("cell")[0].as_py()], [len(x)], [take("id")], [take("vec_id")], [codes.tobytes()], [take("norm")], [x.tobytes()])])

    # slices of about ``size`` rows: a cell's rows are dealt by a hash of their number
    return stored(held.withColumn("slice", F.pmod(F.xxhash64("id"), out_of.cast("long"))).groupBy("cell", "slice").applyInArrow(pack, SLICED), "slices"), model


def members(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, vec_id and embedding of the index's vectors whose vec_id is in ``chosen``."""
    kind = pa.schema([("id", pa.int64()), ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["vectors"]).reshape(r["n"], -1)
                yield rows(kind, pa.array(np.frombuffer(r["ids"], np.int64)), pa.array(np.frombuffer(r["vec_ids"], np.int64)), list(x))

    every = index.select("n", "ids", "vec_ids", "vectors").mapInArrow(run, "id long, vec_id long, embedding array<double>")
    return every.join(chosen.select("vec_id").distinct(), "vec_id", "left_semi")


def best_of(q: np.ndarray, own: np.ndarray, r: dict, model: Additive, k: int, again: int | None):
    """For each query the place in the slice and the exact score of its best rows."""
    x, ids = np.frombuffer(r["vectors"]).reshape(r["n"], -1), np.frombuffer(r["ids"], np.int64)
    vec_ids, codes = np.frombuffer(r["vec_ids"], np.int64), np.frombuffer(r["codes"], np.uint8).reshape(r["n"], -1)
    for q0 in range(0, len(q), 64):
        if again is not None:
            approx = model.scores(q[q0 : q0 + 64], codes)
            cut = np.partition(approx, len(ids) - min(k * again, len(ids)), axis=1)[:, len(ids) - min(k * again, len(ids))]
        for i in range(q0, min(q0 + 64, len(q))):
            some = np.flatnonzero(ids != own[i] if again is None else (approx[i - q0] >= cut[i - q0]) & (ids != own[i]))
            exact = np.einsum("nd,d->n", x[some], q[i])  # equal for equal vectors, unlike a product of matrices
            order = np.lexsort((vec_ids[some], -exact))[:k]
            yield i, vec_ids[some[order]], exact[order]


def search(index: DataFrame | None, model: Additive | None, queries: DataFrame, k: int = 20, again: int = AGAIN, probes: int = PROBES, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best of every query (id, vec_id, embedding, as ``members`` gives them;
    id null where a query is no row of the index)."""
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], RANKED)
    asked = pa.schema([("cell", pa.int32()), ("part", pa.int64()), ("id", pa.int64()), ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    blocked = pa.schema([("cell", pa.int32()), ("own", pa.binary()), ("query_ids", pa.binary()), ("queries", pa.binary())])
    found = pa.schema([("id", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    parts = max(1, -(-queries.count() // block))

    def ask(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                q = matrix(part.column(2))
                cell = np.tile(np.arange(len(model.centres)), (len(q), 1)) if exact else model.asks(q, probes)
                at_row, where = np.repeat(np.arange(len(q)), cell.shape[1]), cell.ravel().astype(np.int32)
                mixed = (part.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * 0x9E3779B1 >> 8) % parts
                yield rows(asked, pa.array(where), pa.array(mixed[at_row]), *(part.column(c).take(pa.array(at_row)) for c in range(3)))

    def gather(group: pa.Table) -> pa.Table:
        x = matrix(group.column("embedding").combine_chunks())
        return pa.Table.from_batches([rows(blocked, [group.column("cell")[0].as_py()], *([group.column(c).to_numpy().astype(np.int64).tobytes()] for c in ("id", "vec_id")), [x.tobytes()])])

    def score(batches):
        for b in batches:
            for r in b.to_pylist():
                own, qid = np.frombuffer(r["own"], np.int64), np.frombuffer(r["query_ids"], np.int64)
                got = list(best_of(np.frombuffer(r["queries"]).reshape(len(own), -1), own, r, model, k, None if exact else again))
                who = np.repeat([g[0] for g in got], [len(g[1]) for g in got])
                yield rows(found, own[who], qid[who], np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]))

    numbered = queries.select(F.coalesce("id", -F.monotonically_increasing_id() - 1).alias("id"), "vec_id", "embedding")
    asks = numbered.mapInArrow(ask, "cell int, part long, id long, vec_id long, embedding array<double>")
    with batches_of(spark, 16):  # rows are blocks and slices
        blocks = stored(asks.groupBy("cell", "part").applyInArrow(gather, "cell int, own binary, query_ids binary, queries binary"), "asked")
        pairs = blocks.join(index.select("cell", "n", "ids", "vec_ids", "codes", "vectors"), "cell")
        got = stored(pairs.drop("cell").mapInArrow(score, "id long, query_id long, vec_id long, score double"), "found")
    # at most k rows for a query from each slice it asked: merged in two steps, so that no task sees all of them
    for keys in (("id", "some"), ("id",)):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        got = got.withColumn("some", F.pmod(F.xxhash64("vec_id"), F.lit(16))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return got.select("query_id", "rank", "vec_id", "score")


RANKED = "query_id long, rank int, vec_id long, score double"


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    index, model = build(vectors)
    if index is None:
        return spark.createDataFrame([], RANKED)
    return search(index, model, members(index, vectors.filter("vec_id % 20 = 0")))
