"""Operator 13: whitening of embeddings from a tall-skinny QR factorisation (TSQR).

Entries become whole numbers ``x = floor(scale * c)``. The fit list is each distinct x vector
once. Its sums are exact (whole numbers), each row is centred with them before anything is
multiplied, every task reduces its rows to one upper triangular factor R, and the factors are
merged as a tree until one is left. The singular values of that R give the eigenvalues of the
covariance and its right vectors the components; the covariance itself is never formed.

What a task holds is a block of rows and a square of the dimension; what the driver gets are one
sum a dimension and one R of each dimension.

Defined results: vectors that are null or hold null or non-finite entries give no rows. Vectors
of different lengths are different spaces, each fitted on its own (``dimension`` says which);
empty vectors have no components. Null and repeated ids are rows like any other. A component
without variance (fewer distinct vectors than dimensions, or one only) has ``whitened`` null and
``explained`` 0. Entries beyond a long when scaled are cut at its bounds, and ``deviation`` is
null where it does not fit a long. An empty table gives no rows. Signs: the largest entry of
each component is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows that a task holds as doubles at a time, and factors that a task of the merge tree takes.
BLOCK_ROWS, FAN = 2048, 16
_SHIFT, _LOW = 32, (1 << 32) - 1
_LONG = (1 << 63) - 1


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, x) of the rows that take part."""
    c = F.col(f"`{vector}`")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    return df.where(c.isNotNull() & ~bad & (F.size(c) > 0)).select(F.col(f"`{key}`"), x.alias("x"))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, matrix) for each length of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        own = column if len(at) == len(sizes) else column.take(pa.array(at))
        yield d, at, own.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """dimension -> (rows, sum of each entry), exact: entries are summed as halves of 32 bits."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                high, low = (x >> _SHIFT).sum(0), (x & _LOW).sum(0)
                n, all_ = held.get(d, (0, [0] * d))
                held[d] = [n + len(x), [a + (int(h) << _SHIFT) + int(lo) for a, h, lo in zip(all_, high, low, strict=True)]]
        for d, (n, all_) in held.items():
            columns = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([v >> _SHIFT for v in all_], pa.int64()), pa.array([v & _LOW for v in all_], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "i", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(partial, "d int, i int, n long, high long, low long")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("n").alias("n"), big("high").alias("high"), big("low").alias("low")).collect():  # a row an entry of the vectors
        out.setdefault(r.d, (r.n, [0] * r.d))[1][r.i] = (int(r.high) << _SHIFT) + int(r.low)
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where they and the sum of their squares fit, else as Python integers."""
    most = max(max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)), 1) if x.size else 1
    if most * most * x.shape[1] <= _LONG:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding an entry where n * x - S is exact as a double."""
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _r(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _raw(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r, "<f8").tobytes()


_FACTOR = "d int, part int, r binary"


def _factors(fit: DataFrame, sums: dict) -> dict[int, np.ndarray]:
    """The one R of each dimension: a factor a task, then merged ``FAN`` at a time."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                for i in range(0, len(x), BLOCK_ROWS):
                    rows = _centred(x[i : i + BLOCK_ROWS], *sums[d])
                    held[d] = _r(np.vstack([held[d], rows]) if d in held else rows)
        part = TaskContext.get().partitionId()
        for d, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([_raw(r)], pa.binary())], names=["d", "part", "r"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        d = key[0].as_py()
        rows = [np.frombuffer(b, "<f8").reshape(-1, d) for _, b in sorted(zip(table.column("part").to_pylist(), table.column("r").to_pylist(), strict=True))]
        return pa.table({"d": pa.array([d], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "r": pa.array([_raw(_r(np.vstack(rows)))], pa.binary())})

    now = written(fit.select("x").mapInArrow(reduced, _FACTOR), "factors")
    while (now.agg(F.max("part")).first()[0] or 0) > 0:
        up = now.withColumn("up", F.expr(f"part div {FAN}").cast("int"))
        now = written(up.groupBy("d", "up").applyInArrow(merged, _FACTOR), "factors")
    return {row.d: np.frombuffer(bytes(row.r), "<f8").reshape(-1, row.d) for row in now.collect()}


class Whitener:
    """The fitted model of one dimension: n, sums, components (columns), their deviations and shares."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray, k: int):
        _, sigma, right = np.linalg.svd(r, full_matrices=True)
        d = len(sums)
        sigma = np.concatenate([sigma, np.zeros(d - len(sigma))])
        e = sigma**2 / n
        total = float(e.sum())
        flat = sigma <= np.finfo(float).eps * max(n, d) ** 0.5 * d * (sigma[0] if len(sigma) else 0)
        self.n, self.sums, self.k = n, sums, min(k, d)
        vectors = right[: self.k].T
        self.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(self.k)] < 0, -1.0, 1.0)
        self.flat = flat[: self.k]
        self.root = np.where(self.flat, np.nan, np.sqrt(e[: self.k]))
        self.explained = np.where(self.flat, 0.0, e[: self.k] / (total or 1.0))

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - S, whitened rows by component); NaN for components without variance."""
        from_mean = _deviations(x, self.n, self.sums)
        return from_mean, (from_mean / self.n).astype(np.float64) @ self.vectors / self.root


def _identity_errors(fit: DataFrame, models: dict[int, Whitener]) -> dict[int, float | None]:
    """The largest entry of |covariance of whitened rows - identity| over the fit list, measured in one more pass."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                for i in range(0, len(x), BLOCK_ROWS):
                    w = models[d].project(x[i : i + BLOCK_ROWS])[1]
                    one, two = held.get(d, [0, 0])
                    held[d] = [one + w.sum(0), two + w.T @ w]
        for d, (one, two) in held.items():
            k = len(one)
            values = np.concatenate([one, two.ravel()])
            names = [pa.array([d] * len(values), pa.int32()), pa.array(range(k + k * k), pa.int32()), pa.array(values)]
            yield pa.RecordBatch.from_arrays(names, names=["d", "i", "v"])

    sums = fit.select("x").mapInArrow(partial, "d int, i int, v double").groupBy("d", "i").agg(F.sum("v").alias("v")).collect()  # k + k * k rows a dimension
    out: dict[int, float | None] = {}
    for d, model in models.items():
        values = np.array([v for _, v in sorted((r.i, r.v) for r in sums if r.d == d)])
        mean, two = values[: model.k] / model.n, values[model.k :].reshape(model.k, model.k) / model.n
        left = (two - np.outer(mean, mean) - np.eye(model.k))[np.ix_(~model.flat, ~model.flat)]
        out[d] = float(np.abs(left).max()) if left.size else None
    return out


def whitening(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """One row a vector that takes part and component: key, component, dimension, n, deviation, whitened, explained, identity_error."""
    rows = whole_vectors(df, key, vector, scale)
    fit = written(rows.select("x").distinct(), "fit")
    sums = _sums(fit)
    factors = _factors(fit, sums)
    models = {d: Whitener(*sums[d], factors[d], k) for d in sums}
    errors = _identity_errors(fit, models)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch.column(1)):
                model = models[d]
                for i in range(0, len(x), BLOCK_ROWS):
                    own = at[i : i + BLOCK_ROWS]
                    apart, w = model.project(x[i : i + BLOCK_ROWS])
                    squares = (apart * apart).sum(1).tolist()
                    m, kk = len(own), model.k
                    rep = lambda v, t=None, m=m: pa.array(np.tile(v, m), t)
                    columns = [
                        batch.column(0).take(pa.array(np.repeat(own, kk))), rep(np.arange(1, kk + 1, dtype=np.int32)), pa.array([d] * (m * kk), pa.int32()), pa.array([model.n] * (m * kk), pa.int64()),
                        pa.array(np.repeat(np.array([s if s <= _LONG else None for s in squares], object), kk), pa.int64()), pa.array(w.ravel(), mask=np.isnan(w.ravel())), rep(model.explained), pa.array([errors[d]] * (m * kk), pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema[key].dataType.simpleString()
    names = [key, "component", "dimension", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.mapInArrow(projected, f"`{key}` {kind}, component int, dimension int, n long, deviation long, whitened double, explained double, identity_error double")
