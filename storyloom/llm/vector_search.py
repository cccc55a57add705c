"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of ``BOOKS`` codewords, one from each of that many full-dimensional codebooks.  The
codebooks start as residual k-means and are refined: beam-search codes, then the least-squares codebooks for those codes.
The index holds, for every vector, its codes (a byte each) and the squared norm of its approximation.  A query needs one table
of inner products with all codewords; ``|q - x|^2`` is then, up to ``|q|^2``, the stored norm less twice a sum of looked-up entries.
The best ``rerank`` of all rows for each query are scored exactly on the original vectors.

Codebooks are fitted on at most ``sample`` vectors, those of the smallest hash of their id (a documented bound); every row is
indexed.  Queries are taken in blocks of about ``QUERY_BLOCK``, each block against all rows: what is broadcast is bounded by that
number.  Each part of the index keeps ``rerank`` rows a query before anything is shuffled.

Rows: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another length than
most vectors have.  Rows repeated with one id are one vector, that of the smallest hash if they differ, and a query if one of them
is.  Equal vectors are equally near, and the smaller id comes first.  Fewer candidates than ``k``: all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared_store import Store

BOOKS, WORDS, BEAM = 64, 32, 4
SAMPLE = 8192
RERANK = 200
QUERY_BLOCK = 4096


class AdditiveQuantizer:
    """books: BOOKS x WORDS x dimensions."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.flat = self.books.reshape(-1, books.shape[2])
        self.gram = self.flat @ self.flat.T

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norms of the approximations) by beam search over the codebooks in turn."""
        codes, norms = [], []
        for at in range(0, len(x), 512):
            c, n = self._encode(x[at : at + 512].astype(np.float32), beam)
            codes.append(c)
            norms.append(n)
        return (np.concatenate(codes), np.concatenate(norms)) if codes else (np.zeros((0, len(self.books)), np.uint8), np.zeros(0, np.float32))

    def _encode(self, x: np.ndarray, beam: int):
        m, k = self.books.shape[:2]
        dots = x @ self.flat.T
        square = np.diag(self.gram)
        cost = np.zeros((len(x), 1), np.float32)
        cross = np.zeros((len(x), 1, m * k), np.float32)
        codes = np.zeros((len(x), 1, 0), np.int64)
        rows = np.arange(len(x))[:, None]
        for j in range(m):
            part = slice(j * k, (j + 1) * k)
            total = cost[:, :, None] + square[part] - 2 * dots[:, None, part] + 2 * cross[:, :, part]
            width = min(beam, total.shape[1] * k)
            flat = total.reshape(len(x), -1)
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            cost = np.take_along_axis(flat, best, 1)
            from_, word = best // k, best % k
            codes = np.concatenate([codes[rows, from_], word[:, :, None]], axis=2)
            cross = cross[rows, from_] + self.gram[j * k + word]
        top = cost.argmin(1)
        best_codes = codes[np.arange(len(x)), top]
        made = self.flat[best_codes + np.arange(m) * k].sum(1)
        return best_codes.astype(np.uint8), (made**2).sum(1)

    def scores(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """queries x rows: squared distance less |q|^2, by table look-up."""
        tables = (q.astype(np.float32) @ self.flat.T).reshape(len(q), *self.books.shape[:2])
        out = np.zeros((len(q), len(codes)), np.float32)
        for j in range(self.books.shape[0]):
            out += tables[:, j, :][:, codes[:, j]]
        return norms[None, :] - 2 * out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def fit_quantizer(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 1, seed: int = 11) -> AdditiveQuantizer:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, found = x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, words, rng)
        found.append(c)
        rest -= c[((c**2).sum(1) - 2 * rest @ c.T).argmin(1)]
    q = AdditiveQuantizer(np.stack(found))
    for _ in range(rounds):
        codes, _ = q.encode(x)
        hot = np.zeros((len(x), books * words), np.float32)
        hot[np.arange(len(x))[:, None], codes + np.arange(books) * words] = 1
        normal = hot.T @ hot
        normal[np.diag_indices_from(normal)] += 1e-2
        # The small ridge pulls towards the codebooks so far, so a word that no vector uses stays.
        solved = np.linalg.solve(normal.astype(float), hot.T @ x + 1e-2 * q.flat)
        q = AdditiveQuantizer(solved.reshape(books, words, -1))
    return q


def usable(vector: str) -> Column:
    """A Column: the vector takes part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _index(batches: Iterator[pa.RecordBatch], quantizer, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, norms = quantizer.value.encode(_matrix(batch.column(1), dims))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32))], names=["vec_id", "codes", "norm"])


def _best(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` smallest by (score, id)."""
    if len(score) > keep:
        limit = np.partition(score, keep - 1)[keep - 1]
        at = np.flatnonzero(score <= limit)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], score[at]))][:keep]


def _scan(batches: Iterator[pa.RecordBatch], quantizer, block, keep: int) -> Iterator[pa.RecordBatch]:
    """One part of the index -> query_id and its best rows there."""
    q_ids, q = block.value
    best_ids = [np.zeros(0, np.int64)] * len(q_ids)
    best = [np.zeros(0, np.float32)] * len(q_ids)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
        norms = batch.column(2).to_numpy(zero_copy_only=False)
        for a in range(0, len(ids), 4096):
            for b in range(0, len(q_ids), 64):
                scores = quantizer.value.scores(q[b : b + 64], codes[a : a + 4096], norms[a : a + 4096])
                for j, row in enumerate(scores, b):
                    own = ids[a : a + 4096] != q_ids[j]
                    s, i = np.concatenate([best[j], row[own]]), np.concatenate([best_ids[j], ids[a : a + 4096][own]])
                    at = _best(s, i, keep)
                    best[j], best_ids[j] = s[at], i[at]
    rows = [k for k in range(len(q_ids)) if len(best[k])]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(q_ids[k]) for k in rows], pa.int64()), pa.array([best_ids[k].tolist() for k in rows], pa.list_(pa.int64())), pa.array([best[k].tolist() for k in rows], pa.list_(pa.float32()))], names=["query_id", "ids", "near"]
        )


def search(vectors: DataFrame, queries: Column, k: int = 10, rerank: int = RERANK, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows of ``vectors`` where ``queries`` holds."""
    spark = vectors.sparkSession
    store = Store(spark, "vectors")
    usable_rows = vectors.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks"))
    sizes = usable_rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out_type = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out_type)
    dims = sizes[0]["d"]
    rows = usable_rows.filter(F.size("v") == dims)
    again = store.write(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "again")
    if not again.isEmpty():
        one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"), F.max("asks").alias("asks"))
        rows = rows.join(again, "vec_id", "left_anti").unionByName(one)
    rows = store.write(rows, "rows")
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    quantizer = spark.sparkContext.broadcast(fit_quantizer(np.stack([np.asarray(x) for x in fitted["v"]])))
    index = store.write(rows.select("vec_id", "v").mapInArrow(partial(_index, quantizer=quantizer, dims=dims), "vec_id long, codes binary, norm float"), "index")
    asked = rows.filter("asks").select("vec_id", "v")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).orderBy("vec_id").collect()  # about QUERY_BLOCK rows
        if not block:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in block]), np.array([r.v for r in block])))
        part = store.write(index.mapInArrow(partial(_scan, quantizer=quantizer, block=sent, keep=rerank), "query_id long, ids array<long>, near array<float>"), f"found{b}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], out_type)
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "near")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.near").alias("near"))
    nearest = Window.partitionBy("query_id").orderBy("near", "vec_id")
    pairs = pairs.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= rerank).select("query_id", "vec_id")
    pairs = pairs.join(rows.select("vec_id", "v"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = F.sqrt(F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.select("query_id", "vec_id", exact.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
