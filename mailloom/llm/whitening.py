"""Whitening of embeddings by their leading principal components, found by LOBPCG.

Vectors are quantised to whole numbers x. Mean and covariance are over the fit list, which has each
distinct x once, so that copies carry no weight. The sums are exact, and rows are centred as
n x - S in whole numbers before anything is multiplied.

The eigenvectors come from the locally optimal block preconditioned conjugate gradient
method: each round asks the cluster for one product of the covariance with a narrow block
(every task centres its rows and multiplies, the blocks are summed in a tree), and the
driver does a Rayleigh-Ritz step on the iterate, the residuals and the previous directions,
all kept orthonormal. Some guard columns beside the wanted ones speed it up. It ends when the residuals,
computed from a fresh product of the iterate itself, are certified to be at rounding level: below
``tol`` times the largest eigenvalue. A matrix of dimensions times dimensions is never made.

Rows whose vector is null or has null or non-finite components take no part. Vectors may differ in
length; a component that is missing counts as 0. Quantised values beyond 64 bits are cut off there. Rows
that repeat an id or a vector give rows of their own; a null id stays null. Components
without variance (below 1e-12 of the largest) are left out, so that equal vectors, a single row
or an empty table give no rows; equal eigenvalues leave the choice of their vectors open. A deviation
beyond 64 bits is null. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, merge_tree, stored

SCALE = 256
COMPONENTS = 4
GUARD = 20
"""Columns beside the wanted ones."""
DIRECT = 64
"""So many tasks' sums, each of a fixed size, go to the driver as they are; those of more are summed in a tree first."""
TOLERANCE = 1e-13
ROUNDING = 1e-11
"""Residuals that no longer fall are accepted up to here, times the largest eigenvalue."""
ROUNDS = 500
NO_VARIANCE = 1e-12
_LIMIT = 1 << 62


def quantised(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (whole numbers) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter("x is not null")
    v = v.filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return v.select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale))).alias("x"))


def padded(d: int):
    return F.when(F.size("x") == d, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))).alias("x")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Centre:
    """The fit list's size, sums and range, and with them the exact centring of rows."""

    n: int
    sums: list[int]
    low: int
    high: int

    @property
    def narrow(self) -> bool:
        """Whether n x - S fits into 64 bits."""
        return self.n * max(abs(self.low), abs(self.high)) < _LIMIT // 2

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as 64-bit integers or, where they may not fit, Python's."""
        return x * self.n - np.array(self.sums, np.int64) if self.narrow else x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return (self.numerators(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact."""
        m = self.numerators(x)
        if self.narrow and x.shape[1] * (self.n * (self.high - self.low)) ** 2 < _LIMIT:
            return (m * m).sum(1).tolist()
        exact = (m.astype(object) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def _sum(dtype: str) -> Callable[[list[bytes]], bytes]:
    return lambda parts: np.sum([np.frombuffer(p, dtype) for p in sorted(parts)], axis=0).tobytes()


def _gathered(fit: DataFrame, make: Callable[[Iterator[np.ndarray]], np.ndarray], d: int, dtype: str) -> np.ndarray:
    """The sum over all tasks of what each makes from its rows, an array of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = make(matrix(b.column(0), d) for b in batches if b.num_rows)
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([0], pa.int32()), pa.array([out.astype(dtype).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["task", "part", "data"])

    parts, add = fit.select("x").mapInArrow(run, "task int, part int, data binary"), _sum(dtype)
    total = add([r.data for r in parts.collect()]) if fit.rdd.getNumPartitions() <= DIRECT else merge_tree(parts, add)[0][1]
    return np.frombuffer(total, dtype)


def centre_of(fit: DataFrame, d: int) -> Centre:
    """Exact sums of the fit list, in two halves of 32 bits."""
    n, low, high = fit.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()

    def halves(blocks: Iterator[np.ndarray]) -> np.ndarray:
        out = np.zeros((2, d), np.int64)
        for x in blocks:
            out += np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
        return out

    high_part, low_part = _gathered(fit, halves, d, "<i8").reshape(2, d).tolist()
    return Centre(n, [(a << 32) + b for a, b in zip(high_part, low_part, strict=True)], low, high)


def covariance_product(fit: DataFrame, centre: Centre, w: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance of the fit list times a block, and the covariance's trace."""
    d, width = w.shape
    shared = fit.sparkSession.sparkContext.broadcast((centre, w))

    def product(blocks: Iterator[np.ndarray]) -> np.ndarray:
        at, block = shared.value
        out = np.zeros(d * width + 1)
        for x in blocks:
            c = at.centred(x)
            out[:-1] += (c.T @ (c @ block)).ravel()
            out[-1] += (c * c).sum()
        return out

    total = _gathered(fit, product, d, "<f8") / centre.n
    return total[:-1].reshape(d, width), float(total[-1])


def _orthonormal(w: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what w adds to the orthonormal columns of ``against``; directions that rounding alone has left are dropped."""
    scale = np.linalg.norm(w, axis=0)
    w = w[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        w = w - against @ (against.T @ w)
        if w.shape[1]:
            u, s, _ = np.linalg.svd(w, full_matrices=False)
            w = u[:, s > 1e-8]
    return w[:, : max(0, w.shape[0] - against.shape[1])]


@dataclass
class Eigen:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int
    products: int


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, tol: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 7) -> Eigen:
    """The k largest eigenvalues of a symmetric positive semi-definite operator and their vectors, with certified residuals."""
    b = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))[0]
    p = ap = np.zeros((d, 0))
    ax, products, fresh, certified = product(x), 1, True, np.inf
    for it in range(1, rounds + 1):
        g = x.T @ ax
        theta, c = np.linalg.eigh((g + g.T) / 2)
        theta, c = theta[::-1], c[:, ::-1]
        x, ax = x @ c, ax @ c
        r = ax - x * theta
        norms = np.linalg.norm(r[:, :k], axis=0)
        top = max(float(theta[0]), 0.0)
        if norms.max() <= tol * top or b == d:
            if not fresh:  # the iterate's product was carried along so far: certify it by a product of its own
                x = np.linalg.qr(x)[0]
                ax, products, fresh = product(x), products + 1, True
                continue
            if norms.max() <= tol * top or norms.max() <= ROUNDING * top and norms.max() > certified / 2 or top == 0:
                return Eigen(theta[:k], x[:, :k], norms, it, products)
            certified = norms.max()
        w = _orthonormal(r, np.hstack([x, p]))
        if not w.shape[1]:
            if fresh:
                if norms.max() <= ROUNDING * top or top == 0:
                    return Eigen(theta[:k], x[:, :k], norms, it, products)
                raise RuntimeError("no direction is left, and the residuals are not small")
            x = np.linalg.qr(x)[0]
            ax, p, ap, products, fresh = product(x), np.zeros((d, 0)), np.zeros((d, 0)), products + 1, True
            continue
        aw, products = product(w), products + 1
        q, aq = np.hstack([x, p, w]), np.hstack([ax, ap, aw])
        g = q.T @ aq
        _, c = np.linalg.eigh((g + g.T) / 2)
        best = c[:, ::-1][:, :b]
        step = best.copy()
        step[:b] = 0
        step = _orthonormal(step, best)
        x, ax, p, ap, fresh = q @ best, aq @ best, q @ step, aq @ step, False
    raise RuntimeError(f"the residuals {norms / max(top, 1e-300)} are not small after {rounds} rounds")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, guard: int = GUARD, tol: float = TOLERANCE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual: a row for each row that takes part and each component.

    The driver gets the fit list's size and sums and blocks of dimensions times
    columns; it never gets rows. ``residual`` is the component's certified residual over the largest eigenvalue.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    v = stored(quantised(vectors, scale, id_col, vector_col), "whole")
    d = v.agg(F.max(F.size("x"))).first()[0] or 0
    if d == 0:
        return spark.createDataFrame([], schema)
    v = v.select("vec_id", padded(d))
    fit = stored(v.select("x").distinct(), "fit")
    centre = centre_of(fit, d)
    trace = 0.0

    def product(w: np.ndarray) -> np.ndarray:
        nonlocal trace
        out, trace = covariance_product(fit, centre, w)
        return out

    found = lobpcg(product, d, min(components, d), guard, tol)
    has = (found.values > NO_VARIANCE * max(found.values[0], 0)) & (found.values > 0)
    values, base = found.values[has], found.vectors[:, has]
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], schema)
    base = base * np.sign(base[np.abs(base).argmax(0), np.arange(k)])
    to = base / np.sqrt(values)
    shared = spark.sparkContext.broadcast((centre, to))

    def spread(blocks: Iterator[np.ndarray]) -> np.ndarray:
        at, block = shared.value
        sums, squares = np.zeros(k), np.zeros((k, k))
        for x in blocks:
            y = at.centred(x) @ block
            sums += y.sum(0)
            squares += y.T @ y
        return np.concatenate([sums, squares.ravel()])

    total = _gathered(fit, spread, d, "<f8") / centre.n
    error = float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())
    explained, residual = values / trace, found.residuals[has] / found.values[0]
    n = centre.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = shared.value
        for b in batches:
            x, m = matrix(b.column(1), d), b.num_rows
            which = np.tile(np.arange(k), m)
            rows = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array(at.deviation(x), pa.int64()).take(rows)
            columns = [b.column(0).take(rows), pa.array((which + 1).astype(np.int32)), pa.array(np.full(m * k, n, np.int64)), deviation]
            columns += [pa.array((at.centred(x) @ block).ravel()), pa.array(explained[which]), pa.array(np.full(m * k, error)), pa.array(residual[which])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return v.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))


def whitening_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of the operator: vec_id, n, deviation of each row that takes part."""
    return whiten(load(spark, sf_dir, "embeddings"), 1).select("vec_id", "n", "deviation")


DEVIATION_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(CAST(c AS DOUBLE))]) = 0),
f AS (SELECT DISTINCT x FROM v),
s AS (SELECT i, sum(x[i]) AS s FROM f, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM v))) AS i) GROUP BY i),
a AS (SELECT list(CAST(s AS BIGINT) ORDER BY i) AS s, (SELECT count(*) FROM f) AS n FROM s)
SELECT vec_id, n, CAST(list_sum([(n * x[i] - s[i]) * (n * x[i] - s[i]) FOR i IN range(1, len(x) + 1)]) AS BIGINT) AS deviation FROM v, a
"""
