"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Every entry becomes a whole number, so sums and centring are exact. With the centred rows as the matrix X
the bidiagonalisation goes on from a fixed start: u = Xv less what earlier u hold of it, then v = X'u less
what earlier v hold of it, both orthogonalised against all earlier vectors. X stays where it is: a step is
one pass in which every task multiplies its own rows, and what leaves it is a vector of sums.

A u has as many entries as there are rows. It is never stored: as each u is X times a short vector, tasks make
all earlier u of their rows again from these short vectors, and send the products of the new u with them.
The next X'u follows from the same pass, as X' of the earlier u is known. Short vectors, at most as many as
there are dimensions, are all that the driver holds.

Where a vector vanishes the recurrence starts again with a fixed direction at right angles to the earlier ones.
It ends when all dimensions are used, or when the wanted components have residuals below rounding. The singular
values and vectors of the small bidiagonal matrix give deviations and components. A last pass measures how far
the whitened covariance is from the identity.

Defined cases: rows whose vector is null, empty, holds null or non-finite entries, or an entry whose whole
number has no 64 bits, are dropped; vectors of different length are different fit lists; repeated rows count
as often as they occur, and rows without an id are rows like others; components without deviation (fewer
different rows than dimensions, equal rows) are left out, so a list of equal rows has no result; a squared
deviation beyond 64 bits is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicwell.llm.tables import settle

COMPONENTS = 32
# How an entry becomes a whole number.
STEPS, SHIFT = 64, 1_000_000
# Rows that a task multiplies at once.
ROWS = 4096
# Residuals and deviations below this share of the largest one count as nothing.
NOTHING = 1e-14
WORD = 1 << 63


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the fit list, entries as whole numbers in one binary value."""
    for batch in batches:
        keep, data, lengths = [], [], []
        for i, vector in enumerate(batch.column(1)):
            values = vector.as_py()
            if not values or any(v is None for v in values):
                continue
            x = np.floor(STEPS * np.array(values, np.float64))
            if not (np.abs(x) < WORD // 2).all():  # neither an infinity nor a nan is below it
                continue
            keep.append(i)
            data.append((x.astype(np.int64) + SHIFT).tobytes())
            lengths.append(len(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int32()), pa.array(data, pa.binary())],
            ["id", "length", "x"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in column])


@dataclass(frozen=True)
class Fit:
    """Rows of one length and the exact sums of each dimension."""

    n: int
    sums: list[int]
    # Whether n * x - S fits a 64-bit number, and a sum of its squares over the dimensions.
    near: bool
    square: bool

    @classmethod
    def of(cls, rows: DataFrame) -> Fit:
        """Sums, and least and largest entry of each dimension, one row per dimension and half of the number."""

        def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(0))
                # Two halves, so that no sum of a batch leaves 64 bits.
                high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                columns = [np.arange(x.shape[1]), np.full(x.shape[1], len(x)), high, low, x.min(0), x.max(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["at", "n", "high", "low", "least", "most"]
                )

        kinds = "at bigint, n bigint, high bigint, low bigint, least bigint, most bigint"
        wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
        found = (
            rows.select("x").mapInArrow(extent, kinds).groupBy("at").agg(
                F.sum("n").alias("n"), *wide, F.min("least").alias("least"), F.max("most").alias("most")
            ).orderBy("at").collect()
        )
        n = found[0].n
        sums = [(int(r.high) << 32) + int(r.low) for r in found]
        spread = [max(abs(n * v - s) for v in (r.least, r.most)) for r, s in zip(found, sums)]
        size = max(max(abs(r.least), abs(r.most)) for r in found)
        return cls(n, sums, n * size < WORD and max(map(abs, sums)) < WORD // 2, sum(v * v for v in spread) < WORD)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | list]:
        """``x - S/n``, and ``n x - S`` as whole numbers."""
        if self.near:
            scaled = self.n * x - np.array(self.sums, np.int64)
        else:
            scaled = self.n * x.astype(object) - np.array(self.sums, object)
        return (scaled / self.n).astype(np.float64), scaled

    def deviation(self, scaled: np.ndarray) -> list[int | None]:
        if self.near and self.square:
            return (scaled * scaled).sum(1).tolist()
        exact = (scaled.astype(object) ** 2).sum(1)
        return [int(v) if v < WORD else None for v in exact]


def _summed(rows: DataFrame, fit: Fit, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of what ``work`` makes of a block of centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = work(fit.centred(_matrix(batch.column(0).slice(at, ROWS)))[0])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "part"])

    parts = rows.select("x").mapInArrow(run, "at bigint, part double")
    found = parts.groupBy("at").agg(F.sum("part").alias("part")).orderBy("at").collect()
    return np.array([r.part for r in found])


def _fresh_direction(rng: np.random.Generator, earlier: np.ndarray) -> np.ndarray:
    """A direction at right angles to the columns of ``earlier``."""
    v = rng.standard_normal(len(earlier))
    for _ in range(3):
        v -= earlier @ (earlier.T @ v)
        v /= math.sqrt(v @ v)
    return v


def bidiagonalise(
    product: Callable[[np.ndarray, np.ndarray], np.ndarray], dims: int, wanted: int
) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of X, largest first.

    ``product(P, p)`` makes one pass: with u = Xp and U = XP it gives U'u, u'u and X'u in one vector.
    """
    rng = np.random.default_rng(0)
    v = rng.standard_normal(dims)
    v /= math.sqrt(v @ v)
    basis = np.empty((dims, 0))  # the v so far
    short = np.empty((dims, 0))  # P: the u so far are X P
    images = np.empty((dims, 0))  # X'U
    small = np.zeros((0, 0))
    link, largest = 0.0, 0.0
    while True:
        k = basis.shape[1]
        p = v - link * short[:, -1] if k else v
        sums = product(short, p)
        held, square, image = sums[:k], sums[k], sums[k + 1 :]
        # Taking the earlier u out of the new one changes its short vector and its image alike.
        p, image = p - short @ held, image - images @ held
        alpha = math.sqrt(max(0.0, square - held @ held))
        largest = max(largest, alpha, link)
        alive = alpha > NOTHING * largest
        if not alive:
            alpha = 0.0
        p, image = (p / alpha, image / alpha) if alive else (np.zeros(dims), np.zeros(dims))
        basis, short, images = (np.column_stack(x) for x in ((basis, v), (short, p), (images, image)))
        small = np.pad(small, ((0, 1), (0, 1)))
        small[k, k] = alpha
        if k:
            # What the new u has lost to the earlier ones, beta among it.
            small[:k, k] = held
            small[k - 1, k] += link
        if k + 1 == dims:
            break
        v = image - basis @ (basis.T @ image)
        v -= basis @ (basis.T @ v)
        link = math.sqrt(v @ v)
        left, sizes, _ = np.linalg.svd(small)
        if k + 1 > wanted and (link * np.abs(left[-1, :wanted]) <= NOTHING * sizes[0]).all() and link > NOTHING * largest:
            break
        if link <= NOTHING * largest:
            link, v = 0.0, _fresh_direction(rng, basis)
        else:
            v /= link
    _, sizes, right = np.linalg.svd(small)
    return basis @ right.T, sizes


def _product(rows: DataFrame, fit: Fit) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def product(short: np.ndarray, p: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            u = x @ p
            return np.concatenate(((x @ short).T @ u, [u @ u], x.T @ u))

        return _summed(rows, fit, work)

    return product


@dataclass(frozen=True)
class Whitening:
    """Components (columns), the square roots of their eigenvalues, and their shares of the trace."""

    fit: Fit
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.components) / self.deviations


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """What whitens the rows ``x`` of one length; None if they are all equal."""
    fit = Fit.of(rows)
    trace = float(_summed(rows, fit, lambda x: np.array([(x * x).sum()]))[0]) / fit.n
    if not trace:
        return None
    dims = len(fit.sums)
    vectors, sizes = bidiagonalise(_product(rows, fit), dims, components)
    kept = min(components, int((sizes > math.sqrt(dims) * NOTHING * sizes[0]).sum()))
    vectors, deviations = vectors[:, :kept], sizes[:kept] / math.sqrt(fit.n)
    vectors = vectors / np.sqrt((vectors * vectors).sum(0))

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x @ vectors) / deviations
        return np.concatenate((w.sum(0), (w.T @ w).ravel()))

    sums = _summed(rows, fit, moments) / fit.n
    covariance = sums[kept:].reshape(kept, kept) - np.outer(sums[:kept], sums[:kept])
    error = float(np.abs(covariance - np.eye(kept)).max())
    return Whitening(fit, vectors, deviations, deviations**2 / trace, error)


def _apply(found: Whitening):
    kept = len(found.deviations)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, scaled = found.fit.centred(_matrix(part.column(1)))
                n = len(x)
                take = pa.array(np.repeat(np.arange(n), kept))
                columns = {
                    "id": part.column(0).take(take),
                    "component": pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), n)),
                    "n": pa.array(np.full(n * kept, found.fit.n)),
                    "deviation": pa.array(found.fit.deviation(scaled), pa.int64()).take(take),
                    "whitened": pa.array(found.scaled(x).ravel()),
                    "explained": pa.array(np.tile(found.explained, n)),
                    "identity_error": pa.array(np.full(n * kept, found.identity_error)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return applied


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``.

    One row per usable vector and component, of up to ``components``.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = dict(rows.dtypes)["id"]
    known = settle(rows.mapInArrow(_whole, f"id {kind}, length int, x binary"), "vectors")
    out = (
        f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    parts = [known.sparkSession.createDataFrame([], out)]
    for r in known.groupBy("length").agg(F.count(F.lit(1))).orderBy("length").collect():
        own = known.where(F.col("length") == r.length).select("id", "x")
        found = fit_whitening(own, components)
        if found is not None:
            parts.append(own.mapInArrow(_apply(found), out))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", id_col)
