"""Whitening of integer vectors by eigenvectors that are refined in higher precision.

Entries become integers, and every different vector counts once. Tasks add up the exact sums, then the
products of vectors centred by them; only the d x d covariance reaches the driver. There its
eigenvectors are found in single precision and corrected by matrix products in extended precision
(Ogita and Aishima): with X nearly orthogonal, R = I - X'X and S = X'AX tell how far X is from being
orthonormal and from diagonalising A, and X + XE takes both away up to the square of the error, where

    E[i, j] = (S[i, j] + l[j] R[i, j]) / (l[j] - l[i]),    l[i] = S[i, i] / (1 - R[i, i])

Where eigenvalues lie closer to each other than the error, the quotient means nothing: such a pair gets R / 2,
which only restores orthogonality, and the columns of a whole cluster are turned among themselves by
the eigenvectors of their small matrix, from which the common part of the eigenvalues is taken off first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pantryline.llm.common import staged

SCALE, COMPONENTS, STEPS = 256, 4, 20
#: Rows that are widened to doubles at once.
ROWS = 4096
LARGEST_LONG = 2**63 - 1


# ---- eigenvectors -----------------------------------------------------------------


def _clusters(values: np.ndarray, reach: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other at no more than `reach`, two or more at a time."""
    order = np.argsort(values)
    groups = np.split(order, np.nonzero(np.diff(values[order]) > reach)[0] + 1)
    return [g for g in groups if len(g) > 1]


def _state(a: np.ndarray, x: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """R, S, the eigenvalues they give, and how close to each other these tell nothing apart."""
    r = np.eye(len(a), dtype=np.longdouble) - x.T @ x
    s = x.T @ a @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding would else be blown up by small gaps
    values = np.diag(s) / (1 - np.diag(r))
    return r, s, values, 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + norm * np.sqrt((r**2).sum()))


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made fully so, each step squaring the error."""
    for _ in range(3):
        x = x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    return x


def eigenpairs(a: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a symmetric matrix in double precision, values falling.

    Of each vector the entry of largest size is positive. Equal eigenvalues have some orthonormal basis.
    """
    size = float(np.abs(a).max(initial=0))
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    high = a.astype(np.longdouble) / size
    x = np.linalg.eigh((a / size).astype(np.float32))[1].astype(np.longdouble)
    norm = np.sqrt((high**2).sum())
    rounding = np.finfo(np.longdouble).eps * len(a)
    last = np.inf
    for _ in range(steps):
        # A cluster can only be turned by eigenvectors of its matrix where its columns are orthonormal.
        x = _orthonormal(x)
        _, _, values, reach = _state(high, x, norm)
        for group in _clusters(values, reach):
            part = x[:, group]
            own = part.T @ high @ part
            own -= np.eye(len(group), dtype=np.longdouble) * np.trace(own) / len(group)
            spread = np.abs(own).max()
            if spread > rounding * norm:
                turned = np.linalg.eigh(((own + own.T) / (2 * spread)).astype(np.float64))[1]
                x[:, group] = part @ turned.astype(np.longdouble)
        r, s, values, reach = _state(high, x, norm)
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > reach
        change = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        np.fill_diagonal(change, np.diag(r) / 2)
        size_of_change = np.abs(change).max()
        if size_of_change <= rounding or far.sum() == far.size - len(a) and size_of_change >= last / 2:
            break
        x = x + x @ change
        last = size_of_change
    x = _orthonormal(x)
    values = np.diag(x.T @ high @ x) / np.diag(x.T @ x) * size
    order = np.argsort(-values, kind="stable")
    x, values = (x / np.sqrt((x**2).sum(axis=0)))[:, order], values[order]
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values.astype(np.float64), (x * sign).astype(np.float64)


# ---- fitting ----------------------------------------------------------------------


def integer_vectors(df: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(id, x): the rows whose vector is there and finite, with its entries as floor(scale * entry)."""
    value = F.col("v").cast("array<double>")
    finite = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole: Column = F.transform(value, lambda c: F.floor(c * scale))
    return (
        df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("v"))
        .filter(F.col("v").isNotNull() & finite)
        .select("id", whole.alias("x"))
    )


def _matrices(parts: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in parts:
        for at in range(0, part.num_rows, ROWS):
            some = part.slice(at, ROWS)
            yield some, np.asarray(some.column(column).flatten(), np.int64).reshape(-1, d)


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, as whole numbers of any size."""
    largest = max(map(abs, sums), default=0) + n * int(max(x.max(initial=0), -int(x.min(initial=0))))
    if largest > LARGEST_LONG:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _sums(fit: DataFrame, d: int) -> list[int]:
    """The exact sum of each dimension; a task sends one number a dimension."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for _, x in _matrices(parts, 0, d):
            wide = int(max(x.max(initial=0), -int(x.min(initial=0)))) * len(x) > LARGEST_LONG
            total = [t + int(s) for t, s in zip(total, x.astype(object if wide else np.int64).sum(axis=0), strict=True)]
        columns = [pa.array(range(d), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "total"])

    rows = fit.mapInArrow(add, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total")).collect()
    return [int(total) for _, total in sorted(map(tuple, rows))]


def _products(fit: DataFrame, d: int, width: int, shaped) -> np.ndarray:
    """The sum over all rows of y y', where `shaped` makes y of a row; a task sends one number a pair."""
    upper_i, upper_j = np.triu_indices(width)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in _matrices(parts, 0, d):
            y = shaped(x)
            total += y.T @ y
        columns = [
            pa.array(upper_i, pa.int32()), pa.array(upper_j, pa.int32()), pa.array(total[upper_i, upper_j], pa.float64())
        ]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    out = np.zeros((width, width))
    for i, j, total in fit.mapInArrow(add, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect():
        out[i, j] = out[j, i] = total
    return out


@dataclass(frozen=True)
class Whitening:
    """A projection fitted on n vectors: `values` and `vectors` (columns) of the leading components."""

    scale: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def known(self) -> np.ndarray:
        """Components along which the vectors differ at all; along others nothing can be scaled to one."""
        return self.values > max(self.trace, 0) * len(self.sums) * 2.0**-50

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer vectors; those that aren't known are 0."""
        centred = _exact(x, self.n, self.sums).astype(np.float64) / self.n
        root = np.where(self.known, np.sqrt(np.maximum(self.values, 0)), np.inf)
        return centred @ self.vectors / root


def learn(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE,
) -> Whitening | None:
    """Fit on each different integer vector once; None where there is no vector with entries.

    The dimension is that of most rows (of equally many, the larger); vectors of another one take no part. Runs
    jobs when called, and writes the different vectors to the shared folder. The driver receives d sums
    and d * d / 2 products.
    """
    rows = integer_vectors(df, id_column, vector_column, scale)
    size = rows.groupBy(F.size("x").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    d = size["d"]
    fit = staged(rows.filter(F.size("x") == d).select("x").distinct(), "different")
    n, sums = fit.count(), _sums(fit, d)
    covariance = _products(fit, d, d, lambda x: _exact(x, n, sums).astype(np.float64) / n) / n
    values, vectors = eigenpairs(covariance)
    k = min(components, d)
    model = Whitening(scale, n, sums, values[:k], vectors[:, :k], float(np.trace(covariance)), None)
    known = model.known
    error = np.abs(_products(fit, d, k, model.project) / n - np.eye(k))[np.ix_(known, known)].max(initial=0.0)
    return Whitening(scale, n, sums, model.values, model.vectors, model.trace, float(error) if known.any() else None)


def whiten(
    df: DataFrame, model: Whitening | None, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(<id>, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    `deviation` is the exact squared length of n * x - sums, null beyond a long. `whitened` is null along
    a component without any variance, `explained` where there is no variance at all. Vectors that are null, hold a
    null or non-finite entry or have another dimension than the model have no rows; repeated rows and
    null ids keep theirs. Without a model there are no rows. Further columns play no part.
    """
    rows = integer_vectors(df, id_column, vector_column, model.scale if model else SCALE)
    id_ddl = rows.schema["id"].dataType.simpleString()
    out = f"id {id_ddl}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_column)
    d, k = len(model.sums), len(model.values)
    explained, known = model.explained(), model.known

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _matrices(parts, 1, d):
            off = _exact(x, model.n, model.sums)
            largest = int(max(off.max(initial=0), -off.min(initial=0)))
            off = off if largest * largest * d <= LARGEST_LONG else off.astype(object)
            deviation = [v if v <= LARGEST_LONG else None for v in map(int, (off * off).sum(axis=1))]
            white = model.project(x)
            m = len(x)
            column = np.tile(np.arange(k), m)
            columns = [
                some.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(column + 1, pa.int32()),
                pa.array(np.full(m * k, model.n), pa.int64()),
                pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                pa.array(white.ravel(), pa.float64(), mask=~known[column]),
                pa.array([explained[i] for i in column.tolist()], pa.float64()),
                pa.array([model.identity_error] * (m * k), pa.float64()),
            ]
            names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.filter(F.size("x") == d).mapInArrow(project, out).withColumnRenamed("id", id_column)
