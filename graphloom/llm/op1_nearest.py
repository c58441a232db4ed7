"""Approximate nearest neighbours by score-aware quantisation and exact reranking.

Vectors are scaled to unit length, so the largest inner product is the largest
cosine. A product quantiser with 16 centroids for each pair of dimensions
(four bits a pair) is fitted to a bounded sample under an anisotropic loss: the
part of the residual that is parallel to the vector, which is what distorts
large inner products, weighs `eta` times as much as the part across it. Codes
are chosen by coordinate descent under that loss, and centroids by solving its
normal equations over all subspaces at once.

Every vector is coded. A task codes its rows, scans the codes for each query
with tables of 256 sums (two four-bit codes make a byte), takes the RERANK
best of every chunk of rows, and ranks those anew by the exact cosine of the
original vectors in double precision. A check follows that loses nothing: for each row the parts
of its residual along and across it are known, which bounds the cosine that its scanned
sum can stand for; rows that may still reach a query's k-th best are compared in single
precision, and those within its rounding by the exact cosine, too. So rows that the codes cannot tell
apart (tight clusters, a large common part) are found all the same. It hands on k rows a query, so only
k x queries x tasks rows are shuffled. The queries are shipped in blocks of about
BLOCK_VALUES numbers, one scan for each block; a block's result is written before the next
block is read.

Of equal vectors only the k + 1 with the smallest ids can be among a query's
k nearest; a chunk leaves the others out beforehand, which loses nothing.

Defined results. Null, zero and non-finite vectors, those with a null or
non-finite component, and rows without an id take no part. Vectors of different
dimensions have no cosine: each dimension is searched by itself. A query is not its own neighbour, nor
is any row of its id. A row that repeats id and vector counts once. Ties go to
the smaller id. With fewer than k candidates all of them are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .linking import saved

K = 5
RERANK = 64
SAMPLE = 8192
CHUNK = 16384
#: Numbers of the query vectors that are shipped at once: 32 MB.
BLOCK_VALUES = 1 << 22
#: The inner product, for unit vectors, above which errors matter; it sets the weight of parallel errors.
THRESHOLD = 0.2
CENTROIDS = 16
#: More than the rounding of a sum of products of two unit vectors in single precision, a thousand dimensions at once.
ROUNDING = 2e-5


class Quantiser:
    def __init__(self, dim: int, threshold: float = THRESHOLD):
        self.dim, self.spaces = dim, -(-dim // 4) * 2  # an even number of pairs
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2)) if dim > 1 else 1.0

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * self.spaces - self.dim))).reshape(len(x), self.spaces, 2).astype(np.float32)

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 5) -> Quantiser:
        """x: unit vectors."""
        rng = np.random.default_rng(seed)
        parts = self._parts(x)
        n = len(x)
        pick = rng.permutation(n)[:CENTROIDS] if n >= CENTROIDS else rng.integers(0, n, CENTROIDS)
        self.centres = parts[pick].transpose(1, 0, 2).copy()
        for step in range(rounds):
            if step < 3:  # plain k-means first
                codes = self._nearest(parts)
                for m in range(self.spaces):
                    count = np.bincount(codes[:, m], minlength=CENTROIDS)
                    for d in range(2):
                        total = np.bincount(codes[:, m], weights=parts[:, m, d], minlength=CENTROIDS)
                        self.centres[m, count > 0, d] = (total / np.maximum(count, 1))[count > 0]
            else:
                self._solve(parts, self._assign(parts))
        return self

    def _nearest(self, parts: np.ndarray) -> np.ndarray:
        return np.stack([((parts[:, m, None, :] - self.centres[m]) ** 2).sum(axis=2).argmin(axis=1) for m in range(self.spaces)], axis=1)

    def _assign(self, parts: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r . x)^2, r the residual of a unit vector x."""
        n = len(parts)
        gap = parts[:, :, None, :] - self.centres[None]
        across = (gap**2).sum(axis=3)
        along = (gap * parts[:, :, None, :]).sum(axis=3)
        codes = across.argmin(axis=2)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.spaces):
                rest = total - along[rows, m, codes[:, m]]
                loss = across[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2
                codes[:, m] = loss.argmin(axis=1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def _solve(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """Centroids of all subspaces that minimise the loss of these codes together."""
        n, size = len(parts), self.spaces * CENTROIDS * 2
        place = ((np.arange(self.spaces) * CENTROIDS)[None, :] + codes)[:, :, None] * 2 + np.arange(2)
        left = np.zeros((size, size))
        right = np.zeros(size)
        for low in range(0, n, 2048):
            p, x = place[low : low + 2048].reshape(-1, 2 * self.spaces), parts[low : low + 2048].reshape(-1, 2 * self.spaces)
            v = np.zeros((len(p), size), dtype=np.float32)
            np.put_along_axis(v, p, x, axis=1)
            left += (self.eta - 1) * (v.T @ v)
            left[np.arange(size), np.arange(size)] += np.bincount(p.ravel(), minlength=size)
            right += self.eta * np.bincount(p.ravel(), weights=x.ravel(), minlength=size)
        left[np.arange(size), np.arange(size)] += 1e-3
        right += 1e-3 * self.centres.reshape(-1)
        self.centres = np.linalg.solve(left, right).reshape(self.spaces, CENTROIDS, 2).astype(np.float32)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte."""
        out = []
        for low in range(0, len(x), 4096):
            codes = self._assign(self._parts(x[low : low + 4096]))
            out.append((codes[:, 0::2] + CENTROIDS * codes[:, 1::2]).astype(np.uint8))
        return np.concatenate(out)

    def residual(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit vector's residual the signed part along it and the length of the part across it."""
        along, across = np.empty(len(x)), np.empty(len(x))
        spaces = np.arange(self.spaces)
        for low in range(0, len(x), 4096):
            part, code = x[low : low + 4096], codes[low : low + 4096]
            both = np.empty((len(part), self.spaces), dtype=np.intp)
            both[:, 0::2], both[:, 1::2] = code % CENTROIDS, code // CENTROIDS
            gap = part - self.centres[spaces, both].reshape(len(part), -1)[:, : self.dim].astype(np.float64)
            a = (gap * part).sum(axis=1)
            along[low : low + 4096] = a
            # what padded dimensions' centroids hold meets zeros of the query only
            across[low : low + 4096] = np.sqrt(np.maximum((gap * gap).sum(axis=1) - a * a, 0.0))
        return along, across

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: the inner products of a query with what each byte stands for."""
        one = np.einsum("qmd,mkd->qmk", self._parts(queries), self.centres)
        return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(queries), self.spaces // 2, 256)


def valid(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(good & (F.size("v") == dim)) if dim else rows.where(good)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    y = x / scale
    y /= np.sqrt((y * y).sum(axis=1))[:, None]
    return y, y.astype(np.float32)


class _Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, rows: slice, score: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate([self.score[rows], score], axis=1)
        ids = np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((ids, -score), axis=1)
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        again = np.zeros(ids.shape, dtype=bool)  # a repeated row stands next to its like
        again[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (score[:, 1:] == score[:, :-1])
        order = np.argsort(again, axis=1, kind="stable")
        score = np.where(again, -np.inf, score)
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1)[:, : self.k], np.take_along_axis(ids, order, 1)[:, : self.k]


def _scan(q: Quantiser, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, single = _units(queries)
        best = _Best(len(queries), k)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                held.append((np.asarray(part.column(0)), _matrix(part.column(1), q.dim)))
                if sum(len(i) for i, _ in held) >= CHUNK:
                    chunk(held, exact, single, best)
                    held = []
        if held:
            chunk(held, exact, single, best)
        at = best.score > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, at.sum(axis=1))), pa.array(best.id[at]), pa.array(best.score[at])], names=["query_id", "vec_id", "score"])

    def chunk(held, exact, single, best) -> None:
        ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, group = np.unique(x, axis=0, return_inverse=True)
        order = np.argsort(group, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(group[order]) > 0))
        place = np.empty(len(ids), dtype=np.int64)
        fresh = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(group[order]) != 0))  # not a repeated row
        rank = np.cumsum(fresh) - 1
        place[order] = rank - np.repeat(rank[start], np.diff(np.append(start, len(ids))))
        keep = np.zeros(len(ids), dtype=bool)
        keep[order] = fresh
        keep &= place <= k
        ids, x = ids[keep], x[keep]
        double, flat = _units(x)
        codes = q.encode(flat)
        columns = [np.ascontiguousarray(codes[:, b]) for b in range(codes.shape[1])]
        along, across = (c.astype(np.float32) for c in q.residual(double, codes))
        rounding = ROUNDING * max(1.0, q.dim / 1024)
        most = min(rerank, len(ids))
        for low in range(0, len(single), 64):
            rows = slice(low, low + 64)
            tables = q.tables(single[rows])
            scores = np.zeros((len(tables), len(ids)), dtype=np.float32)
            for b, col in enumerate(columns):
                scores += tables[:, b].take(col, axis=1)
            scores[ids[None, :] == query_ids[rows, None]] = -np.inf
            top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            real = (exact[rows, None, :] * double[top]).sum(axis=2)
            own = ids[top] == query_ids[rows, None]
            real[own] = -np.inf
            best.add(rows, real, ids[top])
            np.put_along_axis(scores, top, -np.inf, axis=1)
            for i, j in _missed(scores, single[rows], flat, best.score[rows, -1], along, across, rounding):
                at = slice(low + i, low + i + 1)
                best.add(at, (exact[at] * double[j]).sum(axis=1)[None, :], ids[j][None, :])

    return run


def _missed(scores: np.ndarray, queries: np.ndarray, x: np.ndarray, least: np.ndarray, along: np.ndarray, across: np.ndarray, rounding: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query the rows not ranked yet (scores above -inf) whose cosine may be its k-th best, least, or more.

    With a residual of parts a along x and b across it, a scanned sum is s (1 - a) - e, s the
    cosine and |e| <= b sqrt(1 - s^2); for s >= least it is at least least (1 - a) - b sqrt(1 - max(least, 0)^2).
    Where a > 1 the sum falls as s grows: then every row stays.
    """
    floor = np.maximum(least, -2.0).astype(np.float32)[:, None]
    near = np.sqrt(np.maximum(1 - np.maximum(floor, 0) ** 2, 0)) + np.float32(1e-3)
    may = ((scores >= floor * (1 - along) - near * across - 1e-4) | (along >= 1)) & (scores > -np.inf)
    some = np.flatnonzero(may.any(axis=1))
    cols = np.flatnonzero(may.any(axis=0))
    if not len(cols):
        return
    real = queries[some] @ x[cols].T
    hit = (real >= floor[some] - rounding) & may[np.ix_(some, cols)]
    for r in np.flatnonzero(hit.any(axis=1)):
        yield some[r], cols[hit[r]]


_RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, rerank: int = RERANK, sample: int = SAMPLE, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, embedding) the k nearest rows of vectors found."""
    dims = valid(vectors).groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()  # one row for each dimension
    found = [part for dim, rows in dims for part in _nearest_of(dim, rows, vectors, queries, k, rerank, sample, block_values)]
    return reduce(lambda a, b: a.unionByName(b), found) if found else vectors.sparkSession.createDataFrame([], _RESULT)


def _nearest_of(dim: int, rows: int, vectors: DataFrame, queries: DataFrame, k: int, rerank: int, sample: int, block_values: int) -> Iterator[DataFrame]:
    """A table for each block of queries, written as soon as it is found: the driver holds one block at a time."""
    base, asked = valid(vectors, dim), valid(queries, dim).distinct()
    many = asked.count()
    if not many:
        return
    share = min(1.0, sample / rows)
    drawn = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample).collect() or base.limit(16).collect()
    q = Quantiser(dim).fit(_units(np.array([v for _, v in sorted((r[0], r[1]) for r in drawn)]))[1])
    blocks = -(-many * dim // block_values)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        block = sorted((r[0], r[1]) for r in mine.collect())
        if not block:
            continue
        ids, x = np.array([i for i, _ in block], dtype=np.int64), np.array([v for _, v in block])
        found = base.mapInArrow(_scan(q, ids, x, k, rerank), "query_id long, vec_id long, score double")
        ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        yield saved(ranked) if blocks > 1 else ranked


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
