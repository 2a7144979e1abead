"""Nearest neighbours by counting collisions: sorted single projections, query-centred windows, virtual rehashing.

Each vector has ``PROJECTIONS`` random projections. A task takes its rows in chunks, sorts each projection of a chunk, and
widens a window around every query's own projection, level by level. A vector is verified by its true distance once its
windows have met the query's at least ``threshold`` times. A query is done with a chunk when k verified vectors lie within the
radius of its windows, or when the radius reaches a bound beyond which no neighbour can lie: the k-th distance in a
sample, or among what the task has found so far. Nothing else ends a search, so no cap drops candidates.

All rows are indexed where they are read: no vector is shuffled. Queries go to the tasks in blocks of ``BLOCK_BYTES``, one
block at a time; what comes back is at most k rows for each query and task, and those beyond the bound stay.

A vector at the edge of a window's radius is missed with a probability below ``MISS``, a nearer one with less; tests measure recall
against brute force. Defined results: vectors that are null, empty, zero, hold a null or a number that isn't finite, or have
another length than most rows have take no part; every other row is a candidate, repeated rows each by itself, but for a query's own
rows (those of its id); an id that several query rows share is one query (its least vector); rows of null id are
candidates and come last among ties, but are no queries; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import comb, erf, inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm.vectors import chunks, common_length, finite, matrix
from flowloom.plans.scratch import written

PROJECTIONS = 64
#: Half a window's width for a radius of 1.
HALF_WIDTH = 1.36
#: The chance to miss a vector at the radius itself.
MISS = 0.01
#: Virtual rehashing: the radius grows by this factor from level to level; the last of LEVELS is the bound.
GROWTH, LEVELS = 1.3, 5
#: Rows whose projections are sorted together, queries that widen their windows together.
CHUNK_ROWS, QUERY_ROWS = 8192, 512
#: Vectors that bound every query's distance, about so many whatever the size of the table.
SAMPLE_ROWS = 4096
#: Bytes of a block of queries.
BLOCK_BYTES = 16 << 20
#: Stands for a null id inside tasks.
NO_ID = np.iinfo(np.int64).max


def collision_threshold(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, miss: float = MISS) -> int:
    """The most collisions that a vector at the radius reaches with a probability of at least 1 - miss."""
    p, below = erf(half_width / sqrt(2)), 0.0
    for count in range(projections + 1):
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def directions(d: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(20_011).standard_normal((d, projections))


@dataclass
class SortedProjections:
    """The sorted arrays of a chunk."""

    ids: np.ndarray
    vectors: np.ndarray

    def __post_init__(self) -> None:
        across = (self.vectors @ directions(self.vectors.shape[1])).T
        self.order = np.argsort(across, axis=1, kind="stable")
        self.values = np.take_along_axis(across, self.order, axis=1)
        self.threshold = collision_threshold()
        #: Equal vectors may differ in the last bits of their projections.
        self.slack = 1e-9 * float(np.abs(across).max())

    def windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each query's window in each projection (queries x projections)."""
        reach = HALF_WIDTH * radius + self.slack
        first = [np.searchsorted(v, at[:, j] - reach, "left") for j, v in enumerate(self.values)]
        last = [np.searchsorted(v, at[:, j] + reach, "right") for j, v in enumerate(self.values)]
        return np.stack(first, 1), np.stack(last, 1)

    def search(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of the query, ids and distances of verified vectors within its bound (not all of them need be among the k nearest)."""
        at = queries @ directions(queries.shape[1])
        radii = [bound / GROWTH ** (LEVELS - 1 - level) for level in range(LEVELS)]
        windows = [self.windows(at, r) for r in radii]
        for i in range(len(queries)):
            count, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
            seen[self.ids == ids[i]] = True
            places, far = [], []
            low = high = None
            for radius, (first, last) in zip(radii, windows):
                if low is None:
                    rings = [o[a:b] for o, a, b in zip(self.order, first[i], last[i])]
                else:
                    rings = [o[a:b] for o, a, b in zip(self.order, first[i], low)] + [o[a:b] for o, a, b in zip(self.order, high, last[i])]
                low, high = first[i], last[i]
                count += np.bincount(np.concatenate(rings), minlength=len(count))
                fresh = np.flatnonzero((count >= self.threshold) & ~seen)
                if len(fresh):
                    seen[fresh] = True
                    apart = np.sqrt(((self.vectors[fresh] - queries[i]) ** 2).sum(axis=1))
                    inside = apart <= bound[i]
                    places.append(fresh[inside])
                    far.append(apart[inside])
                    if sum(int((f <= radius[i]).sum()) for f in far) >= k:
                        break
            if places:
                yield i, self.ids[np.concatenate(places)], np.concatenate(far)


@dataclass
class Found:
    """The k nearest of each query so far, and the distance that a further one must not exceed."""

    bound: np.ndarray
    k: int

    def __post_init__(self) -> None:
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, query: int, ids: np.ndarray, far: np.ndarray) -> None:
        if query in self.best:
            ids, far = np.concatenate([self.best[query][0], ids]), np.concatenate([self.best[query][1], far])
        near = np.lexsort((ids, far))[: self.k]
        self.best[query] = ids[near], far[near]
        if len(near) == self.k:
            self.bound[query] = min(self.bound[query], far[near[-1]])


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def _bounded(queries: DataFrame, sample: DataFrame, d: int, k: int) -> DataFrame:
    """query_id, v and bound: the k-th distance in the sample, infinite where that has fewer than k others."""
    held = sample.toArrow()  # about SAMPLE_ROWS rows
    sent = queries.sparkSession.sparkContext.broadcast((_ids(held["id"]), matrix(held["v"].combine_chunks(), d)))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        size = (x * x).sum(axis=1)
        for table in chunks(batches, QUERY_ROWS):
            q, own = matrix(table["v"].combine_chunks(), d), table["query_id"].to_numpy()
            norms = (q * q).sum(axis=1)[:, None]
            squared = np.maximum(0.0, norms + size - 2 * (q @ x.T)) + 1e-9 * (norms + size)  # a little more than the truth, never less
            squared[own[:, None] == ids] = inf
            kth = np.sqrt(np.partition(squared, k - 1, axis=1)[:, k - 1]) if len(ids) >= k else np.full(len(q), inf)
            yield pa.RecordBatch.from_arrays([table["query_id"].combine_chunks(), table["v"].combine_chunks(), pa.array(kth, pa.float64())], ["query_id", "v", "bound"])

    return queries.mapInArrow(bounds, "query_id long, v array<double>, bound double")


def _search_block(rows: DataFrame, block: DataFrame, d: int, k: int) -> DataFrame:
    """query_id, vec_id, score: of each task the k nearest within the bound, for one block of queries."""
    held = block.select("query_id", "v", "bound").toArrow()  # BLOCK_BYTES
    sent = rows.sparkSession.sparkContext.broadcast((held["query_id"].to_numpy(), matrix(held["v"].combine_chunks(), d), held["bound"].to_numpy()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, bound = sent.value
        found = Found(np.array(bound), k)
        for table in chunks(batches, CHUNK_ROWS):
            index = SortedProjections(_ids(table["id"]), matrix(table["v"].combine_chunks(), d))
            for start in range(0, len(ids), QUERY_ROWS):
                part = slice(start, start + QUERY_ROWS)
                for i, near, far in index.search(ids[part], vectors[part], found.bound[part].copy(), k):
                    found.add(start + i, near, far)
        for start in range(0, len(ids), QUERY_ROWS):
            some = [(ids[q], *found.best[q]) for q in range(start, min(start + QUERY_ROWS, len(ids))) if q in found.best]
            if some:
                near = np.concatenate([x[1] for x in some])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in some], [len(x[1]) for x in some]), pa.int64()), pa.array(near, pa.int64(), mask=near == NO_ID), pa.array(np.concatenate([x[2] for x in some]), pa.float64())], ["query_id", "vec_id", "score"])

    near = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", F.asc_nulls_last("vec_id")))  # k rows a task at most
    out = written(near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    sent.destroy()
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` found for each of ``queries``, by Euclidean distance.

    ``key`` and ``vector`` name the columns of both.
    """
    narrow = lambda df: df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).filter(finite(F.col("v")) & F.exists("v", lambda c: c != 0))
    rows = narrow(vectors)
    d, n = common_length(rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")))
    rows = rows.filter(F.size("v") == d)
    # one row per id below a threshold of the id's hash: rows that share an id can't swell the sample
    chance = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = rows.filter(F.shiftrightunsigned(F.xxhash64("id", F.lit(13)), 11) < F.lit(int(chance * 2**53))).groupBy("id").agg(F.min("v").alias("v"))
    asked = narrow(queries).filter((F.size("v") == d) & F.col("id").isNotNull()).groupBy(F.col("id").alias("query_id")).agg(F.min(F.col("v").cast("array<double>")).alias("v"))
    bounded = written(_bounded(asked, sample, d, k), "queries")
    blocks = max(1, -(-bounded.count() * d * 8 // BLOCK_BYTES))
    found = [_search_block(rows, bounded.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), d, k) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)
