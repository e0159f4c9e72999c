"""Exact top-k inner products, pruned by segment statistics from coarse to fine.

A vector is cut into segments of equal length l. With the mean m and deviation s of each segment,
``sum l * ((m_x - m_y)^2 + (s_x - s_y)^2)`` is a lower bound of the squared distance of x and y. Both
squared norms are known (``sum l * (m^2 + s^2)``), so the same bound read as an inner product is the upper
bound ``sum l * (m_x m_y + s_x s_y)``. A pair whose bound is under the query's k-th best score so far is
dropped; the others get finer segments, and the survivors their exact integer score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallywright.llm.common import new_folder, stored

LEVELS = (4, 8, 16)
LONG = np.iinfo(np.int64)
#: Under this bound all sums of products are exact in 64-bit floats.
EXACT_IN_FLOAT = float(1 << 53)


def scaled(vector, scale: int = 1024):
    """Components as floor(scale * x), x as double; null where the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return F.when(vector.isNotNull() & fine, whole)


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that the bound is one matrix product."""
    n, dim = x.shape
    edges = np.linspace(0, dim, min(segments, dim) + 1).astype(int)
    parts = []
    for a, b in zip(edges[:-1], edges[1:]):
        piece, root = x[:, a:b], math.sqrt(b - a)
        parts += [piece.mean(axis=1) * root, piece.std(axis=1) * root]
    return np.stack(parts, axis=1) if parts else np.zeros((n, 0))


class QueryBlock:
    """Queries of one dimension with their features and the best candidates so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.floats = vectors.astype(np.float64)
        self.features = [segment_features(self.floats, s) for s in LEVELS]
        self.best = [{} for _ in ids]  # per query: candidate id -> score, at most about 2k kept
        self.threshold = np.full(len(ids), -np.inf)
        self.top = np.abs(self.floats).max(initial=0.0)

    def exact(self, vectors: np.ndarray, floats: np.ndarray, qi: np.ndarray, ci: np.ndarray, dense: bool) -> list[int]:
        if self.top * np.abs(floats).max(initial=0.0) * max(1, floats.shape[1]) < EXACT_IN_FLOAT:
            if dense:
                return (self.floats @ floats.T)[qi, ci].astype(np.int64).tolist()
            parts = [np.einsum("ij,ij->i", self.floats[qi[a : a + 65536]], floats[ci[a : a + 65536]]) for a in range(0, len(qi), 65536)]
            return np.concatenate(parts).astype(np.int64).tolist() if parts else []
        sums = (sum(int(a) * int(b) for a, b in zip(self.vectors[i], vectors[j])) for i, j in zip(qi.tolist(), ci.tolist()))
        return [min(max(s, LONG.min), LONG.max) for s in sums]

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        floats = vectors.astype(np.float64)
        slack = 1e-9 * self.top * np.abs(floats).max(initial=0.0) * max(1, floats.shape[1]) + 1e-6
        alive = self.ids[:, None] != ids[None, :]
        for segments, mine in zip(LEVELS, self.features):
            share = alive.mean() if alive.size else 0.0
            theirs = segment_features(floats, segments)
            if share > 0.1:
                alive &= mine @ theirs.T + slack >= self.threshold[:, None]
            elif share:
                qi, ci = np.nonzero(alive)
                keep = np.einsum("ij,ij->i", mine[qi], theirs[ci]) + slack >= self.threshold[qi]
                alive[qi[~keep], ci[~keep]] = False
        qi, ci = np.nonzero(alive)
        scores = np.array(self.exact(vectors, floats, qi, ci, alive.mean() > 0.05 if alive.size else False), dtype=np.int64)
        good = scores >= self.threshold[qi]
        qi, ci, scores = qi[good], ci[good], scores[good]
        order = np.lexsort((ids[ci], -scores.astype(np.float64), qi))
        qi, ci, scores = qi[order], ci[order], scores[order]
        starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else []
        for a, b in zip(starts, [*starts[1:], len(qi)]):
            self._merge(int(qi[a]), ids[ci[a:b]].tolist(), scores[a:b].tolist())

    def _merge(self, q: int, ids: list[int], scores: list[int]) -> None:
        best = self.best[q]
        for c, s in zip(ids, scores):
            if s > best.get(c, LONG.min - 1):
                best[c] = s
        if len(best) >= self.k:
            kept = sorted(best.items(), key=lambda x: (-x[1], x[0]))[: self.k]
            self.best[q] = dict(kept)
            # ties at the threshold stay in: a smaller id may come later
            self.threshold[q] = kept[-1][1]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for q, best in zip(self.ids.tolist(), self.best):
            for c, s in best.items():
                yield q, c, s


def _matrix(rows: list[list[int]], dim: int) -> np.ndarray:
    return np.array(rows, dtype=np.int64).reshape(len(rows), dim)


def _search(blocks: dict[int, tuple[np.ndarray, np.ndarray]], k: int, step: int = 2048):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {dim: QueryBlock(ids, vectors, k) for dim, (ids, vectors) in blocks.items()}
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                ids, lengths = np.array(part.column(0).to_pylist(), dtype=np.int64), np.array(part.column(1).value_lengths())
                flat, offset = part.column(1).flatten().to_numpy(), np.r_[0, np.cumsum(lengths)]
                for dim in np.unique(lengths).tolist():
                    if dim in ready:
                        at = np.flatnonzero(lengths == dim)
                        vectors = flat[(offset[at][:, None] + np.arange(dim)[None, :])].reshape(len(at), dim)
                        ready[dim].offer(ids[at], vectors)
        found = [row for block in ready.values() for row in block.rows()]
        for a in range(0, len(found), 10000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[a : a + 10000])], names=["query_id", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates of highest inner product.

    Both tables have ``vec_id`` and ``vector``, an array of whole numbers. Ties go to the smaller id. A
    candidate never meets a query of its own id. Null ids, null vectors and vectors with a null take no part;
    vectors of another length than the query's have no product with it. An id on several rows counts once,
    with its best score. A score beyond 64 bits is cut to the nearest 64-bit number. Empty tables give an
    empty result.

    The queries are handled in blocks of a bounded size, each sent to all tasks; every task prunes its share
    of the candidates and returns at most k rows for each query of the block.
    """
    spark = candidates.sparkSession
    usable = (F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    rows = stored(candidates.filter(usable).select(F.col("vec_id").cast("bigint"), F.col("vector").cast("array<bigint>").alias("vector")), "candidates")
    asked = queries.filter(usable).select(F.col("vec_id").cast("bigint"), F.col("vector").cast("array<bigint>").alias("vector"))
    parts = max(1, math.ceil(asked.count() / block))
    asked = stored(asked.repartition(parts).withColumn("part", F.spark_partition_id()), "queries")
    out = new_folder(spark, "nearest")
    schema = "query_id bigint, vec_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    for part in range(parts):
        taken = asked.filter(F.col("part") == part).orderBy("vec_id").toArrow()
        lengths = np.array(taken["vector"].combine_chunks().value_lengths()) if taken.num_rows else np.array([], dtype=int)
        blocks = {}
        for dim in np.unique(lengths).tolist():
            chosen = taken.filter(pa.array(lengths == dim))
            blocks[dim] = (np.array(chosen["vec_id"].to_pylist(), dtype=np.int64), _matrix(chosen["vector"].to_pylist(), dim))
        rows.mapInArrow(_search(blocks, k), schema).write.mode("append").parquet(out)
    found = spark.read.schema(schema).parquet(out).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
