"""Whitening of embeddings by slicing the spectrum of their covariance.

Entries become whole numbers, so counts and sums over the distinct vectors are exact. The covariance of the distinct vectors
is added up on Spark, from centred vectors; the driver gets the matrix, the square of the vectors' length. Its leading
eigenvalues are isolated by inertia: factoring V - s*I into L D Lt, the positive pivots of D tell how many eigenvalues are
above s. Intervals are halved until one eigenvalue is left in each; Rayleigh quotient iteration, which converges cubically,
then gives value and vector. At the end counts just above and below each value certify its number.

Eigenvalues that no two shifts tell apart are an interval with several values; their vectors are made orthogonal to each
other, and any basis of their space is right.

Defined cases: a vector that is null, empty or holds null or non-finite entries takes no part, nor one with an entry beyond
2^55 in size or of another length than most (ties: the longest). Equal vectors count once in the fit, and every row is
returned. Only components of positive variance exist: fewer than asked for if the vectors span fewer dimensions, none (and no
rows) if all are equal. `deviation` is null where it is beyond 64 bits. No valid rows: no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide.llm.common import written

STEPS, SHIFT = 64, 1_000_000
MOST_COMPONENTS = 16
LARGEST = 2.0**55
#: What counts as equal: eigenvalues this close, relative to the largest, are one interval.
CLOSE = 2.0**-46


# --- eigenvalues of a symmetric matrix --------------------------------------------------------------


def positive_pivots(a: np.ndarray) -> int:
    """The number of positive eigenvalues of a symmetric matrix: the signs of D in L D Lt with pivots of one or two rows,
    chosen from the whole rest of the matrix."""
    a = a.copy()
    count = 0
    while len(a):
        # The largest entries on and beside the diagonal; a pivot of two rows where the former are small (Bunch, Parlett).
        on = np.abs(np.diag(a))
        i = int(on.argmax())
        beside = np.abs(a - np.diag(np.diag(a)))
        p, q = divmod(int(beside.argmax()), len(a))
        if on[i] == 0 and beside[p, q] == 0:
            return count
        if on[i] >= 0.6404 * beside[p, q]:
            count += int(a[i, i] > 0)
            column = np.delete(a[:, i], i)
            a = np.delete(np.delete(a, i, 0), i, 1) - np.outer(column, column / a[i, i])
        else:
            count += 1  # such a pivot has an eigenvalue of either sign
            pair = [p, q]
            columns = np.delete(a[:, pair], pair, 0)
            inside = a[np.ix_(pair, pair)]
            a = np.delete(np.delete(a, pair, 0), pair, 1) - columns @ np.linalg.solve(inside, columns.T)
    return count


class Spectrum:
    """The leading eigenvalues and vectors of a symmetric matrix without negative eigenvalues."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = (matrix + matrix.T) / 2
        self.size = len(matrix)
        self.scale = float(np.abs(self.matrix).sum(axis=1).max()) if self.size else 0.0  # no eigenvalue is above
        self.counts = {0.0: self.size, 1.01 * self.scale: 0}
        self.rng = np.random.default_rng(3)

    def above(self, shift: float) -> int:
        """How many eigenvalues are above the shift."""
        if shift not in self.counts:
            self.counts[shift] = positive_pivots(self.matrix - shift * np.eye(self.size))
        return self.counts[shift]

    def interval(self, k: int) -> tuple[float, float]:
        """The closest shifts so far with eigenvalue k between them."""
        low = max(s for s, n in self.counts.items() if n >= k)
        return low, min(s for s, n in self.counts.items() if n < k and s > low)

    def quotient(self, low: float, high: float, found: np.ndarray) -> tuple[float, np.ndarray] | None:
        """Rayleigh quotient iteration from the middle of an interval, orthogonal to the vectors found; None if it leaves it."""
        v = self.rng.standard_normal(self.size)
        value, middle = (low + high) / 2, (low + high) / 2
        error = np.inf
        for step in range(60):
            v -= found @ (found.T @ v)
            v /= np.linalg.norm(v)
            if step >= 3:  # the first steps keep the shift, to come near the interval's own vector
                value = float(v @ self.matrix @ v)
                if not low <= value <= high:
                    return None
                now = float(np.linalg.norm(self.matrix @ v - value * v))
                if now <= 4e-16 * self.scale or now >= error / 2 and error <= CLOSE * self.scale / 8:
                    return value, v
                error = now
            try:
                v = np.linalg.solve(self.matrix - (value if step >= 3 else middle) * np.eye(self.size), v)
            except np.linalg.LinAlgError:  # the shift is the eigenvalue itself
                v = np.linalg.solve(self.matrix - (value + 2e-16 * self.scale) * np.eye(self.size), v)
        return None

    def leading(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """At most `most` positive eigenvalues, falling, and their unit vectors as columns."""
        values, vectors = [], np.zeros((self.size, 0))
        floor = 64 * np.finfo(float).eps * self.size * self.scale
        while len(values) < min(most, self.size) and self.scale > 0:
            k = len(values) + 1
            low, high = self.interval(k)
            if high <= floor:
                break
            several = self.above(low) - self.above(high)
            found = None
            if several == 1 or high - low <= CLOSE * self.scale:
                found = self.quotient(low - (high - low) * (several > 1), high + (high - low) * (several > 1), vectors)
                if found is not None and found[0] <= floor:
                    break
            if found is None:
                middle = (low + high) / 2
                if not low < middle < high:
                    raise ArithmeticError(f"eigenvalue {k} does not converge")
                self.above(middle)
                continue
            values.append(found[0])
            vectors = np.column_stack([vectors, found[1]])
        order = np.argsort(-np.array(values), kind="stable")
        values, vectors = np.array(values)[order], vectors[:, order]
        self.certify(values)
        return values, vectors

    def certify(self, values: np.ndarray) -> None:
        """Every value has its number: fewer eigenvalues than k are above a shift just over it, k or more above one just under."""
        near = 4 * CLOSE * self.scale
        for k, value in enumerate(values, 1):
            if not self.above(value + near) < k <= self.above(value - near):
                raise ArithmeticError(f"{value} is not eigenvalue {k}")


# --- on Spark ---------------------------------------------------------------------------------------


def matrix_of(column: pa.Array, kind) -> np.ndarray:
    """A column of lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False)


def stepped(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that take part, in whole numbers."""
    c = F.col("embedding")
    ok = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) <= LARGEST), F.lit(False)))
    rows = embeddings.select("vec_id", c.cast("array<double>").alias("embedding")).filter(c.isNotNull() & (F.size(c) > 0) & ok)
    lengths = rows.groupBy(F.size(c).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).head(1)
    length = lengths[0][0] if lengths else 0
    x = F.transform(c, lambda v: F.floor(v * STEPS) + SHIFT)
    return rows.filter(F.size(c) == length).select("vec_id", x.alias("x"))


class Sums(NamedTuple):
    """The number of fitted vectors and, exactly, their sums by dimension."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part is subtracted before anything is rounded."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n*x - S)^2, exact; None beyond 64 bits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        y = x - whole
        largest = int(np.abs(y).max(initial=0)) * self.n + self.n
        if largest * largest * max(x.shape[1], 1) < 1 << 63:
            d = y * self.n - rest
            return (d * d).sum(axis=1).tolist()
        d = y.astype(object) * self.n - rest.astype(object)
        return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


def sums_of(fit: DataFrame) -> Sums | None:
    """From two halves of each number, whose sums do not leave 64 bits below 2^31 rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("x"), np.int64)
                n, high, low = n + len(x), high + (x >> 31).sum(axis=0), low + (x & (1 << 31) - 1).sum(axis=0)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([n] * d), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "i long, n long, high long, low long").groupBy("i")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = parts.agg(F.sum("n").alias("n"), *wide).orderBy("i").collect()  # one row for each dimension
    return Sums(rows[0]["n"], [int(r["high"]) * (1 << 31) + int(r["low"]) for r in rows]) if rows else None


def products(fit: DataFrame, sums: Sums, basis: np.ndarray | None = None) -> np.ndarray:
    """The covariance of the fitted vectors, or of their projections on the columns of `basis`, divisor n."""
    shared = fit.sparkSession.sparkContext.broadcast((sums, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, columns = shared.value
        total = None
        for batch in batches:
            if batch.num_rows:
                y = own.centred(matrix_of(batch.column("x"), np.int64))
                y = y if columns is None else y @ columns
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(key, table):
        total = matrix_of(table.column("row").combine_chunks(), float).sum(axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "row": pa.array([total], pa.list_(pa.float64()))})

    schema = "i long, row array<double>"
    parts = fit.select("x").mapInArrow(run, schema)
    rows = parts.groupBy("i").applyInArrow(add, schema).orderBy("i").collect()
    return np.array([r["row"] for r in rows]) / sums.n


class Model(NamedTuple):
    sums: Sums
    values: np.ndarray
    basis: np.ndarray  # columns: eigenvectors over the roots of their eigenvalues
    explained: np.ndarray
    identity_error: float


def fit_whitening(rows: DataFrame, most: int = MOST_COMPONENTS) -> Model | None:
    """Fitted on the distinct vectors of `rows` (x); None without rows."""
    fit = written(rows.select("x").distinct())
    sums = sums_of(fit)
    if sums is None:
        return None
    covariance = products(fit, sums)
    values, vectors = Spectrum(covariance).leading(most)
    basis = vectors / np.sqrt(values) if len(values) else vectors
    error = np.abs(products(fit, sums, basis) - np.eye(len(values))).max() if len(values) else 0.0
    return Model(sums, values, basis, values / np.trace(covariance) if len(values) else values, float(error))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, most: int = MOST_COMPONENTS) -> DataFrame:
    """One row for each vector that takes part and each component: vec_id, component, n, deviation, whitened, explained,
    identity_error."""
    rows = stepped(embeddings)
    model = fit_whitening(rows, most)
    spark = embeddings.sparkSession
    if model is None or not len(model.values):
        return spark.createDataFrame([], WHITENED)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.values)
        for batch in batches:
            x = matrix_of(batch.column("x"), np.int64) if batch.num_rows else np.zeros((0, len(own.basis)), np.int64)
            n = len(x)
            at = pa.array(np.repeat(np.arange(n), k))
            columns = [
                batch.column("vec_id").take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, own.sums.n)),
                pa.array(own.sums.deviations(x), pa.int64()).take(at),
                pa.array((own.sums.centred(x) @ own.basis).reshape(-1)),
                pa.array(np.tile(own.explained, n)),
                pa.array(np.full(n * k, own.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in WHITENED.split(", ")])

    return rows.mapInArrow(run, WHITENED)


def op13(spark, folder: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))
