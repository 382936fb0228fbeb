"""Embedding whitening by a locally optimal block preconditioned conjugate gradient (LOBPCG) eigensolver.

Vectors become integers (a fixed scale), and each different integer vector
counts once in the fit. Its covariance is never formed: a pass over the fit
list gives the product of the covariance and a block of vectors, since tasks
centre their rows, multiply them by the block and add up the outer products;
what leaves a task is one block, what reaches the driver their sum (dimensions
times block width).

Each iteration does a Rayleigh-Ritz step on the span of the iterate, the
residuals and the previous directions, by one pass that multiplies an
orthonormal basis of all three: so residuals are always fresh and never carried
along. A component is certified by the angle to the true eigenvector, at most
its residual over its eigenvalue's gap. Iterations end when all wanted ones
hold it, or when residuals at the level of rounding fall no further. Only then
rows are whitened.

The block is wider than the components asked for, so that close eigenvalues
behind them don't slow it down. Vectors of few dimensions (three blocks or
less span them) are solved by the third Rayleigh-Ritz step at the latest.

Defined results: rows whose vector is null, empty, or holds null, NaN or
infinite entries take no part; rows that repeat and null identifiers give rows
of their own; vectors of each length are fitted and whitened apart; an
eigenvector's entry of largest size is positive, so reruns agree; components
without variance have a null ``whitened`` and explain 0; integers beyond 2^53
and deviations beyond 64 bits are errors; an empty table gives no rows. Only
the identifier and the vector are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, tidy

#: Width of the block beyond the components; iterations at most; the angle (in radians) to be certified; residuals over the
#: largest eigenvalue that are rounding and not error.
GUARD, MOST_ROUNDS, ANGLE, ROUNDING = 12, 200, 1e-11, 1e-12


def _matrix(batch: pa.RecordBatch, rows: np.ndarray, dim: int) -> np.ndarray:
    x = batch.column("x").take(pa.array(rows)) if len(rows) < batch.num_rows else batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, row numbers and integer matrix of the batch's rows of each length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, _matrix(batch, rows, dim)


def integers(vectors: DataFrame, scale: int, *, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, x: the rows that take part, each entry as floor(scale * entry)."""
    v = F.col(vector_col)
    whole = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform(v, lambda c: F.when(F.abs(c.cast("double")) < 2.0**53 / scale, F.floor(F.lit(scale) * c.cast("double"))).otherwise(F.raise_error(F.lit("an entry is beyond 2^53"))).cast("long"))
    return vectors.where(v.isNotNull() & whole).select(F.col(id_col).alias("id"), F.size(v).alias("dim"), x.alias("x"))


@dataclass
class Moments:
    """Of the fit list of one length."""

    n: int
    sums: np.ndarray
    trace: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n


def _summed(fit: DataFrame, make: Callable[[int, np.ndarray], np.ndarray], kind: str) -> dict[int, np.ndarray]:
    """For each length the sum over all rows of ``make(dim, rows)``, a matrix; tasks send one partial sum each, by rows of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                part = make(dim, x)
                total[dim] = total[dim] + part if dim in total else part
        rows = [(dim, r, row.tolist()) for dim, m in total.items() for r, row in enumerate(m)]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64() if kind == "long" else pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, types, strict=True)], names=["dim", "r", "v"])

    parts = fit.select("dim", "x").mapInArrow(tidy(run), f"dim int, r int, v array<{kind}>")
    sums = parts.select("dim", "r", F.posexplode("v").alias("c", "v")).groupBy("dim", "r", "c").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for dim in {s.dim for s in sums}:
        own = [s for s in sums if s.dim == dim]
        m = np.zeros((1 + max(s.r for s in own), 1 + max(s.c for s in own)), np.int64 if kind == "long" else np.float64)
        m[[s.r for s in own], [s.c for s in own]] = [s.v for s in own]
        out[dim] = m
    return out


def moments(fit: DataFrame) -> dict[int, Moments]:
    """Counts and exact sums of each length, then the trace of its covariance over centred rows."""
    sums = _summed(fit, lambda dim, x: np.concatenate([[len(x)], x.sum(axis=0)])[None, :], "long")
    found = {dim: Moments(int(m[0, 0]), m[0, 1:]) for dim, m in sums.items()}
    means = {dim: m.mean for dim, m in found.items()}
    for dim, squares in _summed(fit, lambda dim, x: ((x - means[dim]) ** 2).sum(axis=0)[None, :], "double").items():
        found[dim].trace = float(squares.sum()) / found[dim].n
    return found


def products(fit: DataFrame, found: dict[int, Moments], blocks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Covariance times block for each length, in one pass over the rows."""
    means = {dim: found[dim].mean for dim in blocks}

    def make(dim: int, x: np.ndarray) -> np.ndarray:
        y = x - means[dim]
        return y.T @ (y @ blocks[dim])

    wanted = fit.where(F.col("dim").isin(list(blocks)))
    return {dim: m / found[dim].n for dim, m in _summed(wanted, make, "double").items()}


@dataclass
class Solver:
    """The state of LOBPCG for vectors of one length: the iterate, and the orthonormal basis of the span to search next."""

    dim: int
    wanted: int
    width: int
    x: np.ndarray = None
    basis: np.ndarray = None
    values: np.ndarray = None
    residuals: np.ndarray = None
    best: float = np.inf
    stalled: int = 0
    done: bool = False

    def __post_init__(self):
        start = np.random.default_rng(7).standard_normal((self.dim, min(self.dim, self.width)))
        self.x = self.basis = np.linalg.qr(start)[0]

    def step(self, image: np.ndarray) -> None:
        """Rayleigh-Ritz on the basis, whose product with the covariance is ``image``; then residuals and the next basis."""
        small = self.basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[: self.x.shape[1]]
        self.values, mix = values[order], mix[:, order]
        before, self.x = self.x, self.basis @ mix
        residual = image @ mix - self.x * self.values
        self.residuals = np.linalg.norm(residual, axis=0)
        direction = self.x - before @ (before.T @ self.x)
        worst = float(self.angles().max())
        self.stalled = 0 if worst < self.best / 2 else self.stalled + 1
        self.best = min(self.best, worst)
        level = float(self.residuals[: self.wanted].max()) / float(self.values[0])
        self.done = worst <= ANGLE or (self.stalled >= 3 and level <= ROUNDING)
        self.basis = _basis(self.x, residual, direction)

    def angles(self) -> np.ndarray:
        """Residual over gap for each wanted component; equal ones share a space, and its gap counts."""
        top = float(self.values[0])
        gaps = np.abs(self.values[:, None] - self.values[None, :])
        gap = np.where(gaps <= 1e-12 * top, np.inf, gaps).min(axis=1)
        return (self.residuals / np.where(np.isinf(gap), top, gap))[: self.wanted]


def _basis(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """An orthonormal basis: the iterate, then what the other blocks add to it, each column scaled before."""
    for block in more:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(2):  # twice for rounding
            block = block - x @ (x.T @ block)
        if block.shape[1]:
            x = np.linalg.qr(np.hstack([x, block]))[0]
    return x


@dataclass
class Whitening:
    """Components as columns by falling eigenvalue, with what they were fitted on."""

    moments: Moments
    components: np.ndarray
    values: np.ndarray
    residuals: np.ndarray

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e); NaN where rounding is all there is of a component's variance."""
        real = self.values > 1e-12 * max(self.moments.trace, np.finfo(float).tiny)
        return np.where(real, 1 / np.sqrt(np.where(real, self.values, 1)), np.nan)


def fit_whitening(fit: DataFrame, count: int, guard: int = GUARD) -> dict[int, Whitening]:
    """The ``count`` leading components for each length of ``fit`` (dim, x), whose rows all count once. One pass an iteration for all lengths together."""
    found = moments(fit)
    out: dict[int, Whitening] = {}
    solvers = {dim: Solver(dim, count, count + guard) for dim, m in found.items() if m.trace > 0}
    for dim in found.keys() - solvers.keys():
        k = min(count, dim)
        out[dim] = Whitening(found[dim], np.eye(dim)[:, :k], np.zeros(k), np.zeros(k))
    for _ in range(MOST_ROUNDS):
        images = products(fit, found, {dim: s.basis for dim, s in solvers.items() if not s.done})
        for dim, image in images.items():
            solvers[dim].step(image)
        if all(s.done for s in solvers.values()):
            break
    else:
        raise RuntimeError(f"residuals not certified after {MOST_ROUNDS} passes")
    for dim, s in solvers.items():
        k = min(count, dim)
        u = s.x[:, :k]
        u = u / np.linalg.norm(u, axis=0)
        u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(k)])
        out[dim] = Whitening(found[dim], u, s.values[:k], s.residuals[:k])
    return out


def identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, by one more pass."""

    def make(dim: int, x: np.ndarray) -> np.ndarray:
        z = np.hstack([np.ones((len(x), 1)), whiten(models[dim], x)])
        return z.T @ z

    found = {}
    for dim, m in _summed(fit, make, "double").items():
        second, first = m[1:, 1:] / m[0, 0], m[0, 1:] / m[0, 0]
        real = ~np.isnan(models[dim].scales)
        off = (second - np.outer(first, first) - np.eye(len(second)))[real][:, real]
        found[dim] = float(np.abs(off).max(initial=0.0))
    return found


def whiten(model: Whitening, x: np.ndarray) -> np.ndarray:
    return ((x - model.moments.mean) @ model.components) * model.scales


def deviation(m: Moments, x: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2 as exact integers."""
    most = m.n * int(np.abs(x).max(initial=0)) + int(np.abs(m.sums).max(initial=0))
    if most * most * max(1, x.shape[1]) < 1 << 63:
        return ((m.n * x - m.sums) ** 2).sum(axis=1)
    sums = m.sums.tolist()
    exact = [sum((m.n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    if max(exact, default=0) >= 1 << 63:
        raise OverflowError("a deviation does not fit into 64 bits")
    return np.array(exact, np.int64)


def whitened(vectors: DataFrame, count: int, scale: int, *, id_col: str = "vec_id", vector_col: str = "embedding", guard: int = GUARD) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector that takes part and component."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = integers(vectors, scale, id_col=id_col, vector_col=vector_col)
    fit = materialize(rows.select("dim", "x").distinct(), "whitening-fit")
    models = fit_whitening(fit, count, guard)
    errors = identity_errors(fit, models)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _by_dim(batch):
                m = models[dim]
                k = m.components.shape[1]
                z, r = whiten(m, x), len(x) * k
                share = m.values / m.moments.trace if m.moments.trace > 0 else np.zeros(k)
                columns = [
                    batch.column("id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(r, m.moments.n)), pa.array(np.repeat(deviation(m.moments, x), k)),
                    pa.array(z.reshape(-1), from_pandas=True), pa.array(np.tile(np.maximum(share, 0.0), len(x))), pa.array(np.full(r, errors[dim])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), 4, 256).withColumnRenamed("id", "vec_id")
