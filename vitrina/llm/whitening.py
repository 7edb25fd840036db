"""Embedding whitening by one-sided Jacobi SVD.

Entries become whole numbers, so sums are exact and rows are centred before anything is
multiplied.  Blockwise TSQR: each partition reduces its centred rows block by block to the
triangular factor R, and the factors are merged over a tree, so that the driver gets a few
square matrices of the vectors' width.  Plane rotations then make R's columns orthogonal, all
disjoint pairs of a round at once; the columns' lengths are the standard deviations (times the root of
the rows), accurate for small ones too as no product of R with itself is formed, and the accumulated
rotations are the components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import tree_merged

SCALE, SHIFT = 1024, 100_000
#: Larger entries count as non-finite: below it sums and squares of one block stay exact.
LARGEST = 2.0**30
#: Rows of a block.
ROWS = 4096


def whole(block: np.ndarray) -> np.ndarray:
    """The entries as whole numbers."""
    return np.floor(SCALE * block).astype(np.int64) + SHIFT


def blocks(column: pa.Array, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and whole numbers of blocks of a column of vectors of one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    for a in range(0, len(flat), ROWS):
        yield a, whole(flat[a : a + ROWS])


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vectors have entries, all of them finite and within ``LARGEST``."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return df.where(F.coalesce(fine & (F.size(vector) > 0), F.lit(False)))


@dataclass
class Totals:
    """Number of vectors and their sums by dimension (exact)."""

    n: int
    sums: list[int]

    def plus(self, other: Totals) -> Totals:
        if not self.n or not other.n:
            return self if self.n else other
        return Totals(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less their mean: whole parts are subtracted exactly, then the rest below 1."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - low) - rest

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact ``sum((n * x - S) ** 2)`` of each row, masked where it is beyond a long."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        most = self.n * (int(np.abs(x - low).max(initial=0)) + 1)
        if x.shape[1] * most * most < 1 << 63:
            rest = np.array([s % self.n for s in self.sums], np.int64)
            d = self.n * (x - low) - rest
            return np.ma.array((d * d).sum(1), mask=np.zeros(len(x), bool))
        own = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return np.ma.array([v if v < 1 << 63 else 0 for v in own], mask=[v >= 1 << 63 for v in own], dtype=np.int64)


@dataclass
class Spread:
    """Rows, mean and centred products of whitened rows; blocks merge without losing the centring."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Spread:
        mean = rows.mean(0) if len(rows) else np.zeros(rows.shape[1])
        return Spread(len(rows), mean, (rows - mean).T @ (rows - mean))

    def plus(self, other: Spread) -> Spread:
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        return Spread(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of a square matrix.

    Columns of a pair are rotated in their plane until they are orthogonal; a round has
    disjoint pairs, and the rounds of a sweep meet every pair once.  Ends when a sweep
    finds all pairs orthogonal to working precision.
    """
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    seats = list(range(d + d % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[half:][::-1], strict=True) if max(p, q) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            x, y = a[:, i], a[:, j]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            i, j, x, y = i[turn], j[turn], x[:, turn], y[:, turn]
            zeta = (beta - alpha)[turn] / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            p, q = v[:, i], v[:, j]
            v[:, i], v[:, j] = c * p - s * q, s * p + c * q
        if not turned:
            break
    size = np.sqrt((a * a).sum(0))
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order]


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, as wide as it is high (rows of zeros if there are fewer)."""
    r, d = np.linalg.qr(rows, mode="r"), rows.shape[1]
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


@dataclass
class Whitening:
    """Totals, unit components (columns) by falling variance, and their standard deviations."""

    totals: Totals
    components: np.ndarray
    deviation: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        """Each component's share of the whole variance."""
        e = self.deviation**2
        return e / e.sum() if e.sum() else np.full(len(e), np.nan)

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        """Rows on the first ``k`` components with a variance of 1 each; 0 where there is no variance."""
        own = self.deviation[:k]
        return self.totals.centred(x) @ self.components[:, :k] / np.where(own > 0, own, np.inf)


def over_blocks(df: DataFrame, vector: str, dim: int, each, plus, none):
    """``each`` over all blocks of a column of vectors, merged by ``plus``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = reduce(plus, (each(x) for batch in batches for _, x in blocks(batch.column(0), dim)), none)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], names=["part"])

    return tree_merged(df.select(vector).mapInArrow(run, "part binary"), pickle.loads, plus, none)


def fit(vectors: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of all vectors of one width (usable ones); ``None`` without any."""
    head = vectors.select(F.size(vector)).first()
    if head is None:
        return None
    dim = head[0]
    exact = lambda x: Totals(len(x), [int(s) for s in x.sum(0)])
    totals = over_blocks(vectors, vector, dim, exact, Totals.plus, Totals(0, []))
    r = over_blocks(vectors, vector, dim, lambda x: triangle(totals.centred(x)), lambda a, b: triangle(np.vstack([a, b])), np.zeros((dim, dim)))
    size, components = jacobi(r)
    floor = size[0] * dim * np.finfo(np.float64).eps  # below it a length is rounding
    return Whitening(totals, components, np.where(size > floor, size, 0.0) / np.sqrt(totals.n))


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each usable row and each of the first components: ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``, beside the row's columns but the vector.

    Entries ``c`` are taken as ``floor(1024 c) + 100000``; all usable vectors are fitted, and components have either sign,
    the same in all rows.  Left out are rows whose vectors are null or empty, hold null or non-finite entries
    (or such of more than ``LARGEST``), or are not of the most frequent width (ties: the larger).  Repeated rows and null keys are rows
    like others.  A component without variance whitens to 0 and isn't counted in ``identity_error``, the largest absolute entry of the
    whitened covariance less the identity; without any variance ``explained`` is null.  A deviation beyond a long is
    null.  Clashing columns are replaced; no usable rows give an empty result.
    """
    results = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    names = [f.split()[0] for f in results.split(", ")]
    rows = usable(vectors.drop(*names), vector)
    kept = [c for c in rows.columns if c != vector]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in kept)
    widths = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not widths:
        return rows.sparkSession.createDataFrame([], fields + results)
    dim = widths[0].d
    rows = rows.where(F.size(vector) == dim)
    model = fit(rows, vector)
    k = min(components, dim)
    live = int((model.deviation[:k] > 0).sum())
    none = Spread.of(np.zeros((0, live)))
    spread = over_blocks(rows, vector, dim, lambda x: Spread.of(model.whiten(x, live)), Spread.plus, none)
    error = float(np.abs(spread.products / spread.n - np.eye(live)).max(initial=0.0))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a square of the width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        share = pa.array([None if np.isnan(e) else float(e) for e in own.explained[:k]], pa.float64())
        for batch in batches:
            for a, x in blocks(batch.column(vector), dim):
                n = len(x)
                take = pa.array(np.repeat(np.arange(a, a + n), k))
                deviation = own.totals.deviations(x)
                columns = [
                    *(batch.column(c).take(take) for c in kept),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, own.totals.n, np.int64)),
                    pa.array(np.repeat(deviation.data, k), mask=np.repeat(deviation.mask, k)),
                    pa.array(own.whiten(x, k).ravel()),
                    share.take(pa.array(np.tile(np.arange(k), n))),
                    pa.array(np.full(n * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return rows.mapInArrow(run, fields + results)
