"""Tall matrices as tables.

A tall matrix has one row per key (`term_id` or another key) and the matrix columns `c0, c1, ...`;
a row that is absent is zero. Only its products with itself, a few numbers per pair of columns,
come to the driver. Long sums are passed to Spark as SQL text, one call for all of them.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicmoments.functions.chance import gaussian
from topicmoments.runtime import cut, fits_broadcast, hot_keys, row_bytes, salted_join, shuffle_partitions

# Up to this many sums or products are one aggregate; beyond, tasks add them up on Arrow batches.
MAX_EXPRESSIONS = 64
# Columns summed in one aggregation, well below the field limit of generated code.
COLUMN_BLOCK = 48
# Tasks whose small results are merged in one task before they come to the driver.
FAN_IN = 32


def columns(mat: DataFrame) -> list[str]:
    """The matrix columns of a tall table."""
    return [c for c in mat.columns if re.fullmatch(r"c\d+", c)]


def number(x: float) -> str:
    """A double as SQL text."""
    return f"({float(x)!r}D)"


def linear(cols: Sequence[str], weights: Sequence[float]) -> str:
    """The weighted sum of columns."""
    return " + ".join(f"{c} * {number(w)}" for c, w in zip(cols, weights) if w != 0.0) or "0.0D"


def sums(rows: DataFrame, expressions: Sequence[str]) -> np.ndarray:
    """Sums over all rows, as a small array; no rows give zeros."""
    row = rows.selectExpr(*[f"sum({e}) as s{n}" for n, e in enumerate(expressions)]).first()
    return np.array([0.0 if v is None else v for v in row])


def gaussian_matrix(keys: DataFrame, key: str, n_cols: int, seed: int) -> DataFrame:
    """Standard normal entries for each key, the same for any partitioning."""
    return keys.selectExpr(key, *[f"{gaussian(seed, key, j)} as c{j}" for j in range(n_cols)])


def gram(mat: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The table `(i, j, v)` of sums of products of columns, for all pairs of column numbers."""
    r = len(cols)
    if r * (r + 1) // 2 <= MAX_EXPRESSIONS:
        totals = mat.selectExpr(*[f"coalesce(sum({cols[i]} * {cols[j]}), 0.0D) as g{i}_{j}"
                                  for i in range(r) for j in range(i, r)])
        cells = ", ".join(f"{i}, {j}, g{min(i, j)}_{max(i, j)}" for i in range(r) for j in range(r))
        return totals.selectExpr(f"stack({r * r}, {cells}) as (i, j, v)")

    def partial(batches):
        total = np.zeros((r, r))
        for pdf in batches:
            x = pdf.to_numpy(float)
            total += x.T @ x
        i, j = np.divmod(np.arange(r * r), r)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total.ravel()})

    return (mat.select(*cols).mapInPandas(partial, "i int, j int, v double")
            .groupBy("i", "j").agg(F.sum("v").alias("v")))


def gram_matrix(mat: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """The same products as a small array."""
    out = np.zeros((len(cols), len(cols)))
    for row in gram(mat, cols).collect():
        out[row["i"], row["j"]] = row["v"]
    return out


def column_sums(mat: DataFrame, cols: Sequence[str], weight: str) -> np.ndarray:
    """Column sums weighted by another column, as a small array."""
    parts = [sums(mat, [f"{weight} * {c}" for c in cols[lo:lo + COLUMN_BLOCK]])
             for lo in range(0, len(cols), COLUMN_BLOCK)]
    return np.concatenate(parts)


def times_small(mat: DataFrame, keep: Sequence[str], cols: Sequence[str], right: np.ndarray) -> DataFrame:
    """Multiply by a small matrix from the right; the result's columns are `c0, c1, ...`."""
    names = [f"c{j}" for j in range(right.shape[1])]
    if right.size <= 4 * MAX_EXPRESSIONS:
        return mat.selectExpr(*keep, *[f"{linear(cols, right[:, j])} as {c}" for j, c in enumerate(names)])

    def multiply(batches):
        for pdf in batches:
            out = pd.DataFrame(pdf[list(cols)].to_numpy(float) @ right, columns=names, index=pdf.index)
            yield pd.concat([pdf[list(keep)], out], axis=1)

    types = dict(mat.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"{c} double" for c in names])
    return mat.select(*keep, *cols).mapInPandas(multiply, schema)


def merged(partials: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One array from the arrays `(part, values)` of all tasks: merged in groups of `FAN_IN` tasks, and these on the driver."""
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("part")
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "values": [merge([np.asarray(v) for v in rows["values"]]).ravel()]})

    grouped = partials.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(group, "part int, values array<double>")
    found = [np.array(r["values"]) for r in sorted(grouped.collect(), key=lambda r: r["part"])]
    return merge(found) if found else None


def r_factor(mat: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """The triangular factor of a QR of a tall matrix, with a nonnegative diagonal, by a tree of Householder factors.

    Each task reduces its rows to a small triangle, batch by batch; triangles of several tasks are stacked and
    reduced again. Products of columns, which lose half of the digits, are never formed.
    """
    k = len(cols)

    def reduce_rows(rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(rows, mode="r") if len(rows) else rows

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros((0, k))
        for pdf in batches:
            own = reduce_rows(np.vstack((own, pdf.to_numpy(float))))
        if len(own):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "values": [own.ravel()]})

    found = merged(mat.select(*cols).mapInPandas(local, "part int, values array<double>"),
                   lambda arrays: reduce_rows(np.vstack([a.reshape(-1, k) for a in arrays])))
    out = np.zeros((k, k))
    if found is not None:
        found = found.reshape(-1, k)
        out[:len(found)] = found
    return np.where(np.diag(out) < 0, -1.0, 1.0)[:, None] * out


def orthonormal_step(products: np.ndarray) -> tuple[np.ndarray, bool]:
    """A small matrix that makes columns with these products orthonormal, and whether it does so well.

    It is the triangular factor of a QR with a positive diagonal. Products of nearly dependent
    columns are first moved away from zero; the result then only brings the columns closer to
    orthonormal, and takes another round.
    """
    scale = 1.0 / np.sqrt(np.maximum(np.diag(products), np.finfo(float).tiny))
    scaled = products * scale[:, None] * scale[None, :]
    scaled = (scaled + scaled.T) / 2
    values = np.linalg.eigvalsh(scaled)
    good = values[0] > 1e-12 * values[-1]
    if not good:
        scaled = scaled + 1e-12 * values[-1] * np.eye(len(scaled))
    return scale[:, None] * np.linalg.inv(np.linalg.cholesky(scaled)).T, bool(good)


def orthonormalize(mat: DataFrame, key: str) -> DataFrame:
    """Orthonormal columns with the same span, as a thin QR with a positive diagonal gives.

    The triangular factor comes from a tree of Householder factors, and the columns from one product with its
    inverse; a second factor, of the columns found, removes what an ill-conditioned matrix leaves in them. Directions
    that are no more than rounding of the others are left out with a warning; then the rest is a basis of the span.
    """
    cols = columns(mat)
    mat = cut(mat.select(key, *cols))
    factor = r_factor(mat, cols)
    norms = np.linalg.norm(factor, axis=0)
    scaled = factor / np.where(norms > 0, norms, 1.0)
    _left, sizes, right = np.linalg.svd(scaled)
    rank = int((sizes > 8 * len(cols) * np.finfo(float).eps * max(sizes[0], np.finfo(float).tiny)).sum())
    if rank == len(cols):
        first = np.linalg.inv(factor)
    else:
        warnings.warn(f"{len(cols) - rank} of {len(cols)} columns depend on the others and are left out", stacklevel=2)
        first = (right[:rank].T / sizes[:rank]) / np.where(norms > 0, norms, 1.0)[:, None]
    once = times_small(mat, [key], cols, first)
    second = r_factor(once, columns(once)) if rank else np.zeros((0, 0))
    return times_small(once, [key], columns(once), np.linalg.inv(second))


def normalize_columns(entries: DataFrame) -> DataFrame:
    """Divide each column of `(row, col, v)` by its Euclidean norm."""
    norms = entries.groupBy("col").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    spark = entries.sparkSession
    norms = cut(norms)
    if fits_broadcast(spark, norms.count() * row_bytes(2)):
        joined = entries.join(F.broadcast(norms), "col")
    else:
        sizes = entries.groupBy("col").agg(F.count("*").alias("n"))
        joined = salted_join(entries, norms, "col", F.col("row"), hot_keys(sizes, "col", "n", shuffle_partitions(spark)))
    return joined.select("row", "col", (F.col("v") / F.col("norm")).alias("v"))


def frobenius_norm(entries: DataFrame) -> DataFrame:
    return entries.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def column_dots(old: DataFrame, new: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Dot product of equal columns of two matrices `(row, col, v)`, and whether it passes 1 - tol."""
    pairs = old.withColumnRenamed("v", "a").join(new.withColumnRenamed("v", "b"), ["row", "col"])
    return (pairs.groupBy("col").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
            .withColumn("converged", F.col("dot") > 1.0 - tol))


def condition_number(values: DataFrame) -> DataFrame:
    """Largest over smallest value of a column `v`."""
    return values.agg((F.max("v") / F.min("v")).alias("condition"))


def check_condition(eigenvalues: np.ndarray, upper_bound: float) -> float:
    """Raise when the leading eigenvalues spread wider than allowed."""
    condition = float(np.max(eigenvalues) / np.min(eigenvalues))
    if condition > upper_bound:
        raise ValueError(f"condition number {condition:.6g} of the second moment exceeds {upper_bound:.6g}; "
                         f"leading eigenvalues: {eigenvalues.tolist()}")
    return condition
