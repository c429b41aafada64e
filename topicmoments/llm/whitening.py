"""Whitening of embeddings by an eigendecomposition that takes one vector after the other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicmoments.llm.common import written
from topicmoments.runtime import spread

#: Entries are counted in parts of one 256th.
SCALE = 256
#: Components that are returned.
COMPONENTS = 4
#: Spectra that are joined to one in a task.
FAN_IN = 16
#: Steps of the root finder before it goes on by halving alone; it takes about five.
STEPS = 16
EPS = np.finfo(float).eps
RESULT = """component int, n long, deviation long, whitened double, explained double, identity_error double"""


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """All roots of 1 + rho * sum(weights_j^2 / (poles_j - x)) = 0, with ascending poles and rho > 0.

    Returns the roots and the matrix of poles_j - root_i, in which differences are exact to rounding:
    each root is found as its distance from the nearer of the poles around it. All roots are sought
    at once, each by the quadratic through both neighbouring poles, inside a shrinking bracket.
    """
    m = len(poles)
    squares = rho * weights ** 2
    gap = np.append(np.diff(poles), squares.sum())
    left = np.arange(m)
    rows = np.arange(m)
    # the sign in the middle of each interval says which pole is nearer
    from_left = poles[None, :] - poles[:, None]
    middle = 1.0 + (squares / (from_left - 0.5 * gap[:, None])).sum(axis=1)
    near_right = (middle < 0) & (left < m - 1)
    origin = np.where(near_right, left + 1, left)
    delta = poles[None, :] - poles[origin][:, None]
    low = np.where(near_right, -0.5 * gap, np.where((left == m - 1) & (middle < 0), 0.5 * gap, 0.0))
    high = np.where(near_right, 0.0, np.where((left == m - 1) & (middle < 0), gap, 0.5 * gap))
    eta = 0.5 * (low + high)
    lower = (rows[None, :] <= left[:, None]).astype(float)
    upper = 1.0 - lower
    right = np.minimum(left + 1, m - 1)
    last = left == m - 1
    for step in range(STEPS + 70):
        apart = delta - eta[:, None]
        terms = squares / apart
        below_root, above_root = np.einsum("ij,ij->i", terms, lower), np.einsum("ij,ij->i", terms, upper)
        f = 1.0 + below_root + above_root
        size = 1.0 - below_root + above_root
        below = f < 0
        low, high = np.where(below, eta, low), np.where(below, high, eta)
        done = (np.abs(f) <= 4 * EPS * size) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        if step < STEPS:
            slopes = terms / apart
            psi, phi = np.einsum("ij,ij->i", slopes, lower), np.einsum("ij,ij->i", slopes, upper)
            d1, d2 = apart[rows, left], apart[rows, right]
            with np.errstate(all="ignore"):
                a = (d1 + d2) * f - d1 * d2 * (psi + phi)
                b = d1 * d2 * f
                c = f - d1 * psi - d2 * phi
                root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
                move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
                c_last = f - d1 * psi
                move = np.where(last, d1 + d1 * d1 * psi / c_last, move)
            to = eta + move
            done |= np.abs(move) <= 2 * EPS * np.abs(eta)
            good = np.isfinite(to) & (to > low) & (to < high)
        else:
            to, good = eta, np.zeros(m, dtype=bool)
        eta = np.where(done, eta, np.where(good, to, 0.5 * (low + high)))
    return poles[origin] + eta, delta - eta[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, vector: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of vectors diag(values) vectors' + rho * vector vector', values ascending and rho >= 0.

    Directions that the update hardly has, and all but one of those with equal values, are deflated: they stay as
    they are. The rest is the roots of the secular equation, and eigenvectors from weights that fit those
    roots exactly, which keeps them orthogonal.
    """
    z = vectors.T @ vector
    norm = float(np.sqrt(z @ z))
    size = rho * norm * norm
    if not size > 0:
        return values, vectors
    z = z / norm
    tol = 8 * EPS * max(float(values[-1]), size)
    close = np.flatnonzero(np.diff(values) <= tol)
    if len(close):
        vectors = vectors.copy()
        start = 0
        while start < len(values):
            stop = int(np.searchsorted(values, values[start] + tol, "right"))
            if stop - start > 1:
                # a reflection brings the whole of z among equal values into the last of them
                own = z[start:stop].copy()
                length = np.linalg.norm(own)
                if length > 0:
                    sign = 1.0 if own[-1] >= 0 else -1.0
                    own[-1] += sign * length
                    own /= np.linalg.norm(own)
                    block = vectors[:, start:stop]
                    vectors[:, start:stop] = block - 2.0 * np.outer(block @ own, own)
                    z[start:stop] = 0.0
                    z[stop - 1] = -sign * length
            start = stop
    open_ = np.flatnonzero(size * np.abs(z) > tol)
    if not len(open_):
        return values, vectors
    poles, weights = values[open_], z[open_]
    roots, apart = secular_roots(poles, weights, size)
    m = len(poles)
    # weights for which the found roots are the exact ones
    between = poles[None, :] - poles[:, None]
    between[np.arange(m), np.arange(m)] = 1.0
    ratios = -apart.T / between  # (root_i - pole_j) / (pole_i - pole_j) by pole j and root i
    fitted = np.sqrt(np.abs(np.prod(ratios, axis=1) / size)) * np.where(weights < 0, -1.0, 1.0)
    small = fitted[:, None] / apart.T
    small /= np.sqrt((small * small).sum(axis=0))
    out_values, out_vectors = values.copy(), vectors.copy()
    out_values[open_] = roots
    out_vectors[:, open_] = vectors[:, open_] @ small
    order = np.argsort(out_values, kind="stable")
    return out_values[order], out_vectors[:, order]


@dataclass
class Spectrum:
    """Number, exact sums, mean and the eigenpairs of the scatter about the mean of the vectors so far."""

    size: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    mean: np.ndarray = None
    values: np.ndarray = None
    vectors: np.ndarray = None

    def __post_init__(self) -> None:
        if self.mean is None:
            self.sums = [0] * self.size
            self.mean, self.values, self.vectors = np.zeros(self.size), np.zeros(self.size), np.eye(self.size)

    def add(self, x: np.ndarray) -> None:
        """Take integer vectors one by one: each moves the mean and is one centred rank-one update."""
        safe = x.astype(object) if len(x) and np.abs(x.astype(float)).max() * len(x) >= 2.0 ** 62 else x
        self.sums = [a + int(b) for a, b in zip(self.sums, safe.sum(axis=0))]
        for row in x.astype(float):
            away = row - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + away / self.n

    def join(self, other: Spectrum) -> None:
        """Take another spectrum: one rank-one update for each of its eigenpairs and one for the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        away, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    def row(self, place: int) -> dict:
        return {"place": place, "n": self.n, "sums": [Decimal(s) for s in self.sums], "mean": self.mean.tolist(),
                "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        size = len(row["mean"])
        return cls(size, row["n"], [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["values"]),
                   np.array(row["vectors"]).reshape(size, size))


SPECTRUM = pa.schema([("place", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())),
                      ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])
SPECTRUM_DDL = "place long, n long, sums array<decimal(38,0)>, mean array<double>, values array<double>, vectors array<double>"


def counted(vector: Column, scale: int = SCALE) -> Column:
    """A vector in whole parts of 1 / scale, downwards."""
    return F.transform(vector, lambda c: F.floor(scale * c.cast("double")))


def admissible(vector: Column, scale: int = SCALE) -> Column:
    """Whether a vector has entries and all of them are finite numbers whose parts a long can hold."""
    limit = 2.0 ** 62 / scale
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < limit), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def spectra(fit: DataFrame, size: int) -> DataFrame:
    """One spectrum for each task's part of the vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(size)
        for batch in batches:
            own.add(matrix(batch.column(0), size))
        if own.n:
            yield pa.RecordBatch.from_pylist([own.row(TaskContext.get().partitionId())], SPECTRUM)

    return fit.select("x").mapInArrow(run, SPECTRUM_DDL)


def joined(parts: DataFrame) -> Spectrum | None:
    """All spectra as one: joined in groups of `FAN_IN`, and these again, until one is left."""
    parts = written(parts, "spectra")
    left = parts.count()

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(SPECTRUM.names).to_pylist(), key=lambda r: r["place"])
        whole = Spectrum.of(rows[0])
        for row in rows[1:]:
            whole.join(Spectrum.of(row))
        return pa.Table.from_pylist([whole.row(rows[0]["place"] // FAN_IN)], SPECTRUM)

    levels = 1
    while FAN_IN ** levels < max(left, int(parts.agg(F.max("place")).first()[0] or 0) + 1):
        levels += 1
    for _ in range(levels if left > 1 else 0):
        parts = written(parts.groupBy(F.floor(F.col("place") / FAN_IN).alias("group")).applyInArrow(join, SPECTRUM_DDL), "spectra")
    row = parts.first()
    return None if row is None else Spectrum.of(row.asDict())


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as 64-bit integers where they suffice, else as Python's."""
    bound = n * int(np.abs(x.astype(float)).max(initial=0)) + max(abs(s) for s in sums)
    if bound < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def square_sums(moved: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null where a long cannot hold it."""
    top = int(np.abs(moved).max(initial=0)) if moved.dtype != object else max((abs(v) for v in moved.ravel()), default=0)
    if top * top * moved.shape[1] < 1 << 63:
        return (moved.astype(np.int64) ** 2).sum(axis=1).tolist()
    found = (moved.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def product_sums(fit: DataFrame, size: int, n: int, sums: list[int], right: np.ndarray) -> np.ndarray:
    """Over all vectors, the sums of products of pairs of (1, centred vector times `right`); one matrix leaves a task."""
    shared = fit.sparkSession.sparkContext.broadcast((n, sums, right))
    width = right.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, right = shared.value
        total = np.zeros((width, width))
        for batch in batches:
            away = centred(matrix(batch.column(0), size), n, sums).astype(float) / n
            seen = np.column_stack((np.ones(len(away)), away @ right))
            total += seen.T @ seen
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((width, width))
    # half the square of the number of dimensions, whatever the number of vectors
    for row in fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


@dataclass(frozen=True)
class Whitening:
    """Fitted components, as columns, with their eigenvalues of the covariance, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(fit: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Leading components of different integer vectors `x`, and how far their whitened covariance is from the identity."""
    whole = joined(spectra(spread(fit), size))
    if whole is None:
        return None
    # Rayleigh-Ritz in the whole basis found: one pass gives the covariance in it, which is all but diagonal
    basis, _ = np.linalg.qr(whole.vectors[:, ::-1])
    inside = product_sums(fit, size, whole.n, whole.sums, basis) / whole.n
    covariance = inside[1:, 1:] - np.outer(inside[0, 1:], inside[0, 1:])
    values, turn = np.linalg.eigh(covariance)
    values, vectors = values[::-1], basis @ turn[:, ::-1]
    trace = float(np.trace(covariance))
    some = int((values > size * EPS * max(values[0], 0.0)).sum())
    values, vectors = values[:min(components, some)], vectors[:, :min(components, some)]
    if not len(values):
        return Whitening(whole.n, whole.sums, values, vectors, trace, 0.0)
    seen = product_sums(fit, size, whole.n, whole.sums, vectors / np.sqrt(values)) / whole.n
    error = np.abs(seen[1:, 1:] - np.outer(seen[0, 1:], seen[0, 1:]) - np.eye(len(values))).max()
    return Whitening(whole.n, whole.sums, values, vectors, trace, float(error))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
           components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every vector: id, component, n, deviation, whitened, explained, identity_error.

    Vectors are counted in whole parts of 1 / scale. Each different one is fitted once: n of them with sums S. Tasks take
    their vectors one by one, each as a rank-one update of the eigenpairs about the moving mean, by the roots of the
    secular equation, with deflation. Spectra are joined in groups by one rank-one update for each eigenpair and one for
    the means. A last pass over all vectors gives the covariance in the basis found (Rayleigh-Ritz), whose small
    eigenproblem makes components exact to rounding. deviation is the exact sum of squares of n * x - S, null where a long
    cannot hold it; whitened the coordinate on the component over the root of its eigenvalue; explained that eigenvalue's
    share of the trace; identity_error, the same in all rows, how far the whitened covariance is from the identity.

    Null and empty vectors, and those with a null or non-finite entry or one of 2^62 parts or more, are left out, and so
    are vectors of another length than the most frequent one (the longest of these). Repeated rows are returned as often,
    rows without an id too. There are no more components than dimensions, and none without variance, so equal vectors
    alone, or an empty table, give no rows. Other columns are not read.
    """
    rows = embeddings.select(embeddings[id_col].alias(id_col), embeddings[vector_col].alias("v")).filter(admissible(F.col("v"), scale))
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = f"{_ddl(rows, id_col)}, {RESULT}"
    if common is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    size = common["size"]
    rows = rows.filter(F.size("v") == size).select(id_col, counted(F.col("v"), scale).alias("x"))
    fit = written(rows.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, size, components)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        width = len(m.values)
        for batch in batches:
            moved = centred(matrix(batch.column(1), size), m.n, m.sums)
            whitened = (moved.astype(float) / m.n) @ (m.vectors / np.sqrt(m.values))
            count = len(moved) * width
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(moved)), width))), pa.array(np.tile(np.arange(1, width + 1), len(moved)), pa.int32()),
                 pa.array(np.full(count, m.n)), pa.array(square_sums(moved), pa.int64()).take(pa.array(np.repeat(np.arange(len(moved)), width))),
                 pa.array(whitened.ravel()), pa.array(np.tile(m.values / m.trace, len(moved)) if width else np.zeros(0)),
                 pa.array(np.full(count, m.identity_error))], names)

    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.mapInArrow(run, schema)


def _ddl(rows: DataFrame, name: str) -> str:
    return f"`{name}` {dict(rows.dtypes)[name]}"
