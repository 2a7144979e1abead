"""Whitening of an embedding column by one-sided Jacobi rotations on the R of a blockwise TSQR.

Entries become whole numbers on a grid (x = floor(64 c) + 1000000), so that counts, sums and squared deviations are
exact. Each task compresses its centred rows to an upper triangle R, block by block; triangles meet in groups of
``FAN`` until one is left, so no task holds more than a block and FAN triangles. Plane rotations then make R's columns
orthogonal: their norms are the standard deviations times sqrt(n), and the accumulated rotations are the components. No
covariance is formed on the way, so small deviations keep their relative accuracy.

Defined results: rows whose vector is null, empty, or holds a null, a NaN or an infinity take no part, nor do those of
another length than most rows have; ids may be null or repeat, and each row is a row of its own; an empty table gives no
rows; other columns pass through ``transformed``, and columns of its own names (``deviation``, ``whitened``) are replaced.
A component without variance (constant dimensions, one row, fewer rows than dimensions) has ``whitened`` null and
``explained`` 0. A deviation beyond a long is null. An entry of 2^46 or more, which the grid can't hold, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.vectors import common_length, finite, matrix
from flowloom.plans.scratch import written

GRID, ORIGIN = 64, 1_000_000
#: Triangles that meet in one task.
FAN = 16
#: Rows that are compressed at once, for each dimension.
BLOCK = 16
LARGEST = 2**63 - 1


def on_grid(vectors: np.ndarray) -> np.ndarray:
    scaled = np.floor(vectors * GRID)
    if scaled.size and np.abs(scaled).max() >= 2**52:
        raise ValueError("an entry of 2^46 or more is outside the grid")
    return scaled.astype(np.int64) + ORIGIN


def one_sided_jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and the right singular vectors as columns.

    A sweep meets all pairs of columns in rounds of disjoint pairs, which are rotated together.
    """
    a, d = np.array(r, dtype=float), r.shape[1]
    v, seats, tolerance = np.eye(d), np.arange(d + d % 2), d * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            alpha, beta, gamma = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            slope = np.abs(gamma) / np.where(size > 0, size, 1.0)
            worst = max(worst, slope.max(initial=0.0))
            turn = slope > tolerance
            if turn.any():
                p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
                zeta = (beta - alpha) / (2 * gamma)
                tan = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, tan)
                sin = cos * tan
                for m in (a, v):
                    left, right = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = cos * left - sin * right, sin * left + cos * right
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= tolerance:
            break
    norms = np.sqrt((a**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fitted model: n rows with sums ``sums`` on the grid; ``components`` are rows, ``spread`` their standard deviations (0: none)."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    spread: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def multiples(self, vectors: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return on_grid(vectors) * self.n - self.sums

    def project(self, multiples: np.ndarray) -> np.ndarray:
        """A row per vector; a component without variance gives NaN."""
        return (multiples / self.n) @ self.components.T / np.where(self.spread > 0, self.spread, np.nan)

    def transformed(self, rows: DataFrame, vector: str = "embedding") -> DataFrame:
        """The rows that take part with ``deviation`` (long) and ``whitened`` (an entry per component, null where there is no variance)."""
        d = len(self.sums)

        @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
        def apply(v: pa.Array) -> pa.Array:
            y = self.multiples(matrix(v, d))
            w = self.project(y)
            flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
            return pa.StructArray.from_arrays([pa.array(squares(y), pa.int64()), lists], ["deviation", "whitened"])

        packed = rows.filter(finite(F.col(f"`{vector}`")) & (F.size(f"`{vector}`") == d)).select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in ("deviation", "whitened")]).alias("_row"), F.col(f"`{vector}`").alias("_v"))
        return packed.select("_row", apply("_v").alias("_w")).select("_row.*", "_w.deviation", "_w.whitened")


def squares(y: np.ndarray) -> list:
    """The exact sum of squares of each row; None beyond a long."""
    if not y.size or float(np.abs(y).max()) ** 2 * y.shape[1] < 2**62:
        return (y * y).sum(axis=1).tolist()
    exact = [sum(int(c) ** 2 for c in row) for row in y]
    return [s if s <= LARGEST else None for s in exact]


def _sums(vectors: DataFrame) -> DataFrame:
    """d, n, sums: a row per task and length of vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                x = on_grid(matrix(batch.column(0).filter(pa.array(lengths == d)), int(d)))
                held = found.setdefault(int(d), [0, np.zeros(int(d), np.int64)])
                held[0] += len(x)
                held[1] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.int64()))], ["d", "n", "sums"])

    return written(vectors.mapInArrow(add, "d int, n long, sums array<long>"), "sums")


def _triangle(vectors: DataFrame, model: Whitening) -> np.ndarray:
    """R of the centred rows: a triangle per task, then FAN of them to one until one is left."""
    d = len(model.sums)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, n = np.zeros((0, d)), [], 0
        for batch in batches:
            held.append(model.multiples(matrix(batch.column(0), d)) / model.n)
            n += len(batch)
            if n >= BLOCK * d:
                r, held, n = np.linalg.qr(np.concatenate([r, *held]), mode="r"), [], 0
        if n or len(r):
            r = np.linalg.qr(np.concatenate([r, *held]), mode="r")
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["block", "r"])

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        stack = np.concatenate([np.reshape(r, (-1, d)) for r in part.sort_values("block")["r"]])
        return pd.DataFrame({"block": [key[0]], "r": [np.linalg.qr(stack, mode="r").ravel().tolist()]})

    blocks = written(vectors.mapInArrow(compress, "block long, r array<double>"), "triangles")
    while blocks.count() > 1:
        blocks = written(blocks.groupBy(F.expr(f"block div {FAN}").alias("to")).applyInPandas(meet, "block long, r array<double>"), "triangles")
    return np.reshape(blocks.first()["r"], (-1, d))


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over the components that have variance."""
    d, real = len(model.sums), np.flatnonzero(model.spread > 0)
    if not len(real):
        return 0.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(real), len(real)))
        for batch in batches:
            w = model.project(model.multiples(matrix(batch.column(0), d)))[:, real]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["c"])

    entries = vectors.mapInArrow(add, "c array<double>").select(F.posexplode("c").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    same = F.when(F.col("at") % (len(real) + 1) == 0, 1.0).otherwise(0.0)
    return float(entries.agg(F.max(F.abs(F.col("v") / model.n - same))).first()[0])


def fit(rows: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening:
    """Fits on all rows that take part: three passes over the vectors, of which a triangle and a few sums leave each task."""
    vectors = rows.select(F.col(f"`{vector}`").alias("v")).filter(finite(F.col("v")))
    found = _sums(vectors)
    d, n = common_length(found)
    if not n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    each = found.filter(F.col("d") == d).select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()  # d rows
    sums = np.array([r["s"] for r in sorted(each, key=lambda r: r["at"])], dtype=np.int64)
    centred = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    vectors = vectors.filter(F.size("v") == d)
    norms, turned = one_sided_jacobi(_triangle(vectors, centred))
    k = min(components, d)
    power, least = (norms**2).sum(), norms[0] * d * 1e-14
    signs = np.where(turned[np.abs(turned).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)  # the largest entry is positive
    spread = np.where(norms > least, norms / np.sqrt(n), 0.0)[:k]
    model = Whitening(n, sums, (turned * signs).T[:k], spread, np.where(spread > 0, norms[:k] ** 2 / (power or 1.0), 0.0))
    return Whitening(n, sums, model.components, spread, model.explained, _identity_error(vectors, model))


def long_form(model: Whitening, rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    parts = model.transformed(rows.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_vector")), "_vector").select("_key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    return parts.select(
        F.col("_key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
