"""Whitening of vectors by an exact covariance from squares alone.

Entries become integers. What is aggregated are squares of centred values: of every
dimension, and of the sum of every two dimensions. As

    var(x + y) = var(x) + var(y) + 2 cov(x, y),

their differences give every covariance without a product of two dimensions, and as
all of it is integer arithmetic, no order of addition changes a bit. The driver holds
one number for each pair of dimensions, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * entry) + SHIFT.
SCALE = 1024
SHIFT = 100_000
#: Entries whose integer is not below this have no exact double; they count as not finite.
LARGEST = 1 << 52
#: Rows that are squared at once.
ROWS = 1024
_EXACT = pa.decimal128(38, 0)


def _usable(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all entries as doubles, first entry of each row and the end, which rows hold finite entries only)."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    values = pc.fill_null(pc.cast(vectors.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    fine = np.abs(values) < LARGEST / SCALE - SHIFT  # false for what is not a number
    wrong = np.concatenate([[0], np.cumsum(~fine)])
    good = (wrong[at[1:]] == wrong[at[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    return values, at, good


def integer_rows(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows that take part, their integers as a matrix)."""
    values, at, good = _usable(vectors)
    rows = np.flatnonzero(good & (np.diff(at) == dims))
    taken = values[at[rows][:, None] + np.arange(dims)] if len(rows) else np.empty((0, dims))
    return rows, np.floor(SCALE * taken).astype(np.int64) + SHIFT


def _whole(sums: np.ndarray) -> list[int]:
    return [int(v) for v in sums]


def column_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of an integer matrix, in halves that cannot overflow."""
    low = _whole((x & 0xFFFFFFFF).sum(0))
    return [(h << 32) + n for h, n in zip(_whole((x >> 32).sum(0)), low)]


def pair_squares(y: np.ndarray) -> list[int]:
    """Exact sums of squares of every dimension, then of the sum of every two dimensions in order."""
    dims = y.shape[1]
    total = [0] * (dims * (dims + 1) // 2)
    most = 2 * int(np.abs(y).max(initial=0))
    step = ROWS if most * most * ROWS < 1 << 63 else 1
    for low in range(0, len(y), step):
        part = y[low : low + step]
        if most >= 3_000_000_000:  # a single square may pass 63 bits
            part = part.astype(object)
        parts = [(part * part).sum(0)]
        for i in range(dims - 1):
            both = part[:, i + 1 :] + part[:, i : i + 1]
            parts.append((both * both).sum(0))
        total = [a + int(b) for a, b in zip(total, np.concatenate(parts))]
    return total


def covariance(n: int, left: list[int], squares: list[int]) -> np.ndarray:
    """Covariance matrix (divisor n), each entry rounded once.

    ``squares`` are of values centred at whole numbers, ``left`` is what the sums of those values
    are short of zero; n² Σ y² - n r² is the exact sum of (n x - S)² for x = y + centre.
    """
    dims = len(left)
    own = [n * s - r * r for s, r in zip(squares[:dims], left)]
    out, k = np.empty((dims, dims)), dims
    for i in range(dims):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, dims):
            both = n * squares[k] - (left[i] + left[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n * n)
            k += 1
    return out


@dataclass
class Whitening:
    """What a fit found: ``scale`` columns turn integers less ``centre`` and ``left / n`` into whitened values."""

    n: int
    dims: int
    centre: list[int]
    left: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def projected(self, x: np.ndarray) -> np.ndarray:
        y = (x - np.array(self.centre, np.int64)).astype(float) - np.array([r / self.n for r in self.left])
        return y @ (self.vectors / np.sqrt(self.values))


def _slim(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))


def dimension(df: DataFrame, vector: str) -> int:
    """Length of most usable vectors (the greater one on a tie); 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, good = _usable(batch.column(0))
            sizes, counts = np.unique(np.diff(at)[good], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(counts)], ["size", "n"])

    sizes = _slim(df, vector).mapInArrow(run, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()  # one row
    return most[0].size if most else 0


def _summed(df: DataFrame, vector: str, dims: int, parts) -> dict[int, int]:
    """Exact sums over all rows of the numbers that ``parts`` gives for an integer matrix, by position.

    A task adds up its own rows and hands on one row for each position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for batch in batches:
            own = parts(integer_rows(batch.column(0), dims)[1])
            total = [a + b for a, b in zip(total, own)] if total else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array([Decimal(t) for t in total], _EXACT)], ["k", "s"]
        )

    sums = _slim(df, vector).mapInArrow(run, "k int, s decimal(38,0)").groupBy("k").agg(F.sum("s").alias("s"))
    return {r.k: int(r.s) for r in sums.collect()}  # one row for each dimension or pair of dimensions


def fit(df: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """Components of all usable vectors; None where no dimension varies.

    Vectors that are null, or hold a null or an entry that is not finite, take no part, nor do
    vectors of another length than most. Components whose eigenvalue is zero up to rounding can't be
    whitened and are left out.
    """
    dims = dimension(df, vector)
    if not dims:
        return None
    sums = _summed(df, vector, dims, lambda x: [len(x), *column_sums(x)])
    n, totals = sums[0], [sums[1 + i] for i in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in totals]
    left = [s - n * c for s, c in zip(totals, centre)]
    squares = _summed(df, vector, dims, lambda x: pair_squares(x - np.array(centre, np.int64)))
    matrix = covariance(n, left, [squares[k] for k in range(len(squares))])
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > dims * np.finfo(float).eps * max(values.max(), 0)][:components]
    if not len(order):
        return None
    return Whitening(n, dims, centre, left, values[order], vectors[:, order], float(np.trace(matrix)))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity, measured on all rows."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = model.projected(integer_rows(batch.column(0), model.dims)[1])
            first += z.sum(0)
            second += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([first, second.ravel()]))], ["k", "s"])

    sums = _slim(df, vector).mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    found = np.zeros(k + k * k)
    for r in sums:
        found[r.k] = r.s
    mean = found[:k] / model.n
    return float(np.abs(found[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, carried: list[str], vector: str = "embedding") -> DataFrame:
    """``row`` (the carried columns), ``deviation`` (exact sum of (n x - S)² over dimensions) and ``whitened`` of each vector that takes part.

    Rows that can't take part are not returned; equal rows stay as many as they are. One
    row of an input partition at a time, no shuffle.
    """
    slim = df.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    n, centre, left = model.n, np.array(model.centre, np.int64), model.left
    rest = sum(r * r for r in left)
    split = [np.array([r >> 20 for r in left], np.int64), np.array([r & 0xFFFFF for r in left], np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integer_rows(batch.column(1), model.dims)
            y = x - centre
            if np.abs(y).max(initial=0) * int(max(model.dims, 1 << 20)) >= 1 << 40:
                y = y.astype(object)  # rare: far outliers, in whole numbers of any size
            square = (y * y).sum(1)
            cross = [(y * part).sum(1) for part in split]
            deviation = [n * n * int(a) - 2 * n * ((int(b) << 20) + int(c)) + rest for a, b, c in zip(square, *cross)]
            z = model.projected(x)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([Decimal(d) for d in deviation], _EXACT), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))],
                ["row", "deviation", "whitened"],
            )

    return slim.mapInArrow(run, f"row {slim.schema['row'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")


def components(df: DataFrame, carried: list[str], vector: str = "embedding", count: int = 8) -> DataFrame:
    """One row for each vector that takes part and each component: ``row``, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    model = fit(df, vector, count)
    if model is None:
        row = df.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")).schema["row"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"row {row}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(df, model, vector)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    one = whiten(df, model, carried, vector).select("row", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return one.select(
        "row", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"),
    )
