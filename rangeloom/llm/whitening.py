"""Whitening of embeddings by exact covariances: products of digit slices, merged as big integers.

Entries become integers, ``floor(scale * c) + offset``. Sums and products of integers are exact in any
order, so the covariance does not depend on how rows are dealt to tasks:

1. the sums S of all n vectors give the mean S / n; ``y = n * x - S`` is a vector centred, in integers;
2. **digit slices**: y is split into signed limbs of ``LIMB`` bits, as many as its largest entry needs.
   Products of two limbs over at most ``BLOCK`` rows stay below 2^53, so float64 BLAS computes them
   exactly; a task recombines them by shifts to one big integer for each pair of dimensions;
3. tasks give those integers as digits of 30 bits, which Spark adds up by pair of dimensions and digit;
   the driver gets one number for each of them, whatever the number of vectors;
4. the covariance, sum of y y' over n^3, is rounded once to double, and decomposed on the driver. Its size
   depends on the dimensions only;
5. rows are projected where they are read; the covariance of the result is measured in one more pass.

Vectors that are null, or hold null or non-finite entries, are dropped, and so are vectors of another
length than the most frequent one (of equally frequent ones the longest). An entry whose integer is
beyond 62 bits counts as the largest that isn't. Components whose eigenvalue is zero up to rounding are
left out, as they can't be scaled to one: one vector, or equal ones, have none. Ties between eigenvalues
leave their components free within their plane. A null vec_id is carried through, repeated rows are
whitened as often as they occur, other columns are ignored, whatever their names, and an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Bits of a limb, and rows of a product: 2 * LIMB + log2(BLOCK) is at most 53.
LIMB, BLOCK = 20, 8192
#: Bits of the digits that are added up by Spark: 2^33 tasks can add theirs to a long.
DIGIT = 30
LARGEST = (1 << 62) - 1
SUMS = "i int, j int, digit int, value long"


def integers(flat: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    """``floor(scale * c) + offset`` as 64-bit integers; far beyond them, the largest ones."""
    scaled = np.floor(flat.astype(np.float64) * scale)
    return np.clip(np.where(np.abs(scaled) < 2.0**62, scaled, 0).astype(np.int64) + offset, -LARGEST, LARGEST) + np.where(scaled >= 2.0**62, LARGEST, np.where(scaled <= -(2.0**62), -LARGEST, 0))


def rows_of(batch: pa.RecordBatch, dims: int, scale: int, offset: int) -> tuple[pa.Array, np.ndarray]:
    """The ids and integer vectors of a batch of whole vectors of the same length."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return batch.column("vec_id"), integers(flat, scale, offset).reshape(-1, dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``: as 64-bit integers where they hold it, else as Python's."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, sums), default=0) <= LARGEST:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Slices of ``LIMB`` bits as doubles, lowest first; only the last one has a sign."""
    out = []
    while True:
        if y.size == 0 or (-(1 << LIMB - 1) <= y.min() and y.max() < 1 << LIMB - 1):
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def products(y: np.ndarray) -> np.ndarray:
    """The exact sum of y y' over the rows, as big integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK):
        slices = limbs(y[at:at + BLOCK])
        for a, left in enumerate(slices):
            for b in range(a, len(slices)):
                part = (left.T @ slices[b]).astype(np.int64).astype(object)
                total = total + ((part if a == b else part + part.T) << LIMB * (a + b))
    return total


def digits(total: np.ndarray) -> pa.RecordBatch:
    """Rows ``i, j, digit, value`` of the upper half of a matrix of big integers; only the highest digit of a number has a sign."""
    out: list[list] = [[], [], [], []]
    for (i, j), value in np.ndenumerate(total):
        if i > j:
            continue
        value, k = int(value), 0
        while True:
            low = value if -(1 << DIGIT) < value < 1 << DIGIT else value & ((1 << DIGIT) - 1)
            for column, cell in zip(out, (i, j, k, low), strict=True):
                column.append(cell)
            if low == value:
                break
            value, k = value >> DIGIT, k + 1
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "digit", "value"])


def added_up(tasks: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of what the tasks have: one number for each cell and digit comes to the driver."""
    total = np.zeros(shape, object)
    for i, j, digit, value in tasks.groupBy("i", "j", "digit").agg(F.sum("value").alias("value")).collect():
        total[i, j] += value << DIGIT * digit
    return total


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector`` of the rows that count."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    return rows.where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


class Whitening:
    """Count, sums, eigenvalues and axes of the vectors of a table, and the rows they came from."""

    def __init__(self, vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> None:
        self.scale, self.offset = scale, offset
        rows = usable(vectors, id_column, vector_column)
        lengths = rows.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
        self.dims, self.n = (lengths[0]["dims"], lengths[0]["n"]) if lengths else (0, 0)
        self.rows = rows.where(F.size("vector") == self.dims)
        self.sums: list[int] = []
        self.values, self.axes, self.explained = np.zeros(0), np.zeros((self.dims, 0)), np.zeros(0)
        if self.n:
            self.sums = self._sums()
            self._decompose(self._products(), components)

    def _each_task(self, body) -> DataFrame:
        """The digits of what ``body`` adds up over the batches of a task."""
        dims, scale, offset = self.dims, self.scale, self.offset

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                part = body(rows_of(batch, dims, scale, offset)[1])
                total = part if total is None else total + part
            if total is not None:
                yield digits(total)

        return self.rows.mapInArrow(run, SUMS)

    def _sums(self) -> list[int]:
        def body(x: np.ndarray) -> np.ndarray:
            high, low = (x >> 31).sum(0).astype(object), (x & ((1 << 31) - 1)).sum(0).astype(object)
            return ((high << 31) + low).reshape(1, -1)

        return added_up(self._each_task(body), (1, self.dims))[0].tolist()

    def _products(self) -> np.ndarray:
        n, sums = self.n, self.sums
        upper = added_up(self._each_task(lambda x: products(centred(x, n, sums))), (self.dims, self.dims))
        return np.triu(upper) + np.triu(upper, 1).T

    def _decompose(self, total: np.ndarray, components: int) -> None:
        cube = self.n**3
        covariance = np.array([[float(Fraction(int(v), cube)) for v in row] for row in total])
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1], axes[:, ::-1]
        kept = int((values[:components] > max(values[0], 0) * self.dims * np.finfo(float).eps * 4).sum())
        trace = float(Fraction(sum(int(total[i, i]) for i in range(self.dims)), cube))
        self.values, self.axes, self.explained = values[:kept].copy(), axes[:, :kept].copy(), values[:kept] / (trace or 1.0)

    def _project(self):
        """A function from centred integers to whitened values, for use inside tasks."""
        n, axes, scales = float(self.n), self.axes, np.sqrt(self.values)
        return lambda y: (y.astype(np.float64) / n) @ axes / scales

    def transform(self) -> DataFrame:
        """``vec_id, deviation, whitened`` of each row: the squared distance from the sums, and an array by component.

        The deviation has up to 38 digits; one that needs more is null.
        """
        dims, n, sums, scale, offset, project = self.dims, self.n, self.sums, self.scale, self.offset, self._project()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = rows_of(batch, dims, scale, offset)
                y = centred(x, n, sums)
                if y.dtype != object and max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) ** 2 * dims <= LARGEST:
                    deviation = pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    exact = (y.astype(object) ** 2).sum(1)
                    deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                values = project(y)
                ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
                yield pa.RecordBatch.from_arrays([ids, deviation, pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))], names=["vec_id", "deviation", "whitened"])

        kind = self.rows.schema["vec_id"].dataType.simpleString()
        return self.rows.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")

    def identity_error(self) -> float:
        """The largest difference between the covariance of the whitened rows, as measured, and the identity; 0 without components."""
        dims, n, sums, scale, offset, project, k = self.dims, self.n, self.sums, self.scale, self.offset, self._project(), len(self.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k + 1))
            for batch in batches:
                w = project(centred(rows_of(batch, dims, scale, offset)[1], n, sums))
                total += np.c_[w.T @ w, w.sum(0)]
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

        if not k:
            return 0.0
        total = np.zeros((k, k + 1))
        for i, j, value in self.rows.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
            total[i, j] = value
        mean = total[:, k] / n
        return float(np.abs(total[:, :k] / n - np.outer(mean, mean) - np.eye(k)).max())


def components(model: Whitening) -> DataFrame:
    """One row per vector and component, with what the component explains and the error that was measured."""
    share = F.array(*(F.lit(float(v)) for v in model.explained)) if len(model.explained) else F.lit(None).cast("array<double>")
    rows = model.transform().select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
                       F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error()).alias("identity_error"))
