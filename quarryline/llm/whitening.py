"""Embedding whitening from an exact integer scatter (operator 11).

An entry c of a vector becomes the long x = floor(scale * c) + offset; the fit list is each distinct vector x once. Tasks subtract
a shift, sum entries and cross-products in integers without rounding, and send each sum as digits of DIGIT bits, which
Spark adds up by place. Of those the driver forms n*XtX - S*St in Python's integers, however long they are, and only then goes over to
floating point: each entry is divided by n*n, rounded once, and eigh decomposes the result. What reaches the driver are
the d*(d+1)/2 sums of d dimensions, whatever the number of rows.

Cross-products run as float64 matrix products that cannot round: shifted entries are cut into signed limbs of LIMB bits, and a block has so few
rows that the products of two limbs stay below 2**53.

Vectors that are null, hold null or non-finite entries, or an entry whose x does not fit 62 bits, are dropped, as are empty
ones. Vectors of different lengths are different spaces: each length has its own fit list, mean and components (n counts that list). Components
whose eigenvalue is zero to double precision can't be whitened and give no rows, so a fit list of one vector, or of equal ones, gives none. Repeated rows
count once in the fit list and each get their rows; ids may be null or repeated. An empty table gives an empty result, columns besides the id and the
vector are not read. deviation is null where the exact sum has over 38 digits (in the query: where it does not fit a long).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import DOUBLE, INT, LONG, map_in_arrow, stored, struct, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows of a block, bits of a limb (2 * (LIMB - 1) + log2(BLOCK) <= 52), and bits of the digits that tasks send.
BLOCK, LIMB, DIGIT = 4096, 20, 32
EXACT = T.DecimalType(38, 0)


@dataclass
class Basis:
    """Of the vectors of one length: n, exact sums, components as rows, their eigenvalues and shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def integers(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """ident and x (array of long) of the vectors that take part."""
    fits = lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < float(1 << 62))  # noqa: E731  false for NaN, which is greater than all
    whole = lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long")
    kept = df.select(ident, F.col(vector).alias("v")).where(F.forall("v", fits) & (F.size("v") > 0))
    return kept.select(ident, F.transform("v", whole).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _by_length(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """(length, rows with it) of a column of lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the columns of an int64 matrix and of the products of any two, as arrays of Python integers."""
    d = x.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(x), BLOCK):
        rest, limbs = x[at : at + BLOCK], []
        while rest.any():
            low = ((rest + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
            limbs.append(low.astype(np.float64))
            rest = (rest - low) >> LIMB
        for i, a in enumerate(limbs):
            sums += a.sum(0).astype(np.int64).astype(object) << (LIMB * i)
            for j, b in enumerate(limbs):
                products += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return sums, products


def _digits(value: int) -> list[tuple[int, int]]:
    """(place, digit) of an integer; all digits have its sign."""
    sign, rest, out, place = (-1 if value < 0 else 1), abs(value), [], 0
    while rest:
        out.append((place, sign * (rest & ((1 << DIGIT) - 1))))
        rest, place = rest >> DIGIT, place + 1
    return out


SUMS = struct(d=INT, i=INT, j=INT, place=INT, digit=LONG)


def scatter(fit: DataFrame, shift: int) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """length -> n, sums, n*XtX - S*St as Python integers, for the distinct vectors in fit.x."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for d, at in _by_length(batch.column(0)):
                sums, products = cross_products(_matrix(batch.column(0).take(pa.array(at))) - shift)
                old = held.setdefault(d, [0, 0, 0])
                held[d] = [old[0] + len(at), old[1] + sums, old[2] + products]
        rows = []
        for d, (n, sums, products) in held.items():
            named = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
            rows += [(d, i, j, place, digit) for i, j, value in named for place, digit in _digits(int(value))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=SUMS.names)

    added = map_in_arrow(fit.select("x"), run, SUMS).groupBy("d", "i", "j", "place").agg(F.sum("digit").alias("digit")).collect()
    n, sums, products = {}, {}, {}
    for r in added:
        value = r.digit << (DIGIT * r.place)
        if r.i < 0:
            n[r.d] = n.get(r.d, 0) + value
        elif r.j < 0:
            sums.setdefault(r.d, [0] * r.d)[r.i] += value
        else:
            products.setdefault(r.d, np.zeros((r.d, r.d), object))[r.i, r.j] += value
    out = {}
    for d, count in n.items():
        s, half = np.array(sums.get(d, [0] * d), object), products.get(d, np.zeros((d, d), object))
        full = half + half.T - np.diag(np.diag(half))
        out[d] = (count, [int(v) + count * shift for v in s], count * full - np.outer(s, s))  # a shift leaves n*XtX - S*St as it is
    return out


def decompose(n: int, sums: list[int], exact: np.ndarray, k: int = COMPONENTS) -> Basis:
    d = len(sums)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in exact], np.float64).reshape(d, d)  # one rounding
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = int(np.sum(values[:k] > max(values[0], 0) * d * np.finfo(float).eps)) if values[0] > 0 else 0
    trace = sum(int(exact[i, i]) for i in range(d)) / (n * n)
    return Basis(n, sums, np.ascontiguousarray(vectors[:, :used].T), values[:used].copy(), values[:used] / trace if used else values[:0])


def _centred(x: np.ndarray, basis: Basis) -> np.ndarray:
    """n * x - S, exact: int64 where that holds its squares' sum, else Python integers."""
    n, low, high = basis.n, int(x.min()), int(x.max())
    most = max(max(abs(n * high - s), abs(n * low - s)) for s in basis.sums)
    # n * x and S may not fit where their difference does: both are taken about the same multiple of n
    base = basis.sums[0] // n
    if len(basis.sums) * most * most < 1 << 62 and n * max(abs(high - base), abs(low - base)) < 1 << 62:
        return (x - base) * n - np.array([s - base * n for s in basis.sums], np.int64)
    return x.astype(object) * n - np.array(basis.sums, object)


def project(x: np.ndarray, basis: Basis) -> tuple[np.ndarray, np.ndarray]:
    """Deviations (exact) and whitened coordinates of the rows of x."""
    y = _centred(x, basis)
    exact = (y / basis.n).astype(np.float64) if y.dtype != object else np.array([[int(v) / basis.n for v in row] for row in y], np.float64)
    return (y * y).sum(1), exact @ basis.components.T / np.sqrt(basis.values)


def _whitened(df: DataFrame, bases: dict[int, Basis]) -> DataFrame:
    """d and w (the coordinates) of the vectors in df.x."""

    def run(batches):
        for batch in batches:
            for d, at in _by_length(batch.column(0)):
                _, w = project(_matrix(batch.column(0).take(pa.array(at))), bases[d])
                ends = np.arange(len(at) + 1, dtype=np.int32) * w.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))], names=["d", "w"])

    return map_in_arrow(df.select("x"), run, struct(d=INT, w=T.ArrayType(DOUBLE)))


def identity_errors(fit: DataFrame, bases: dict[int, Basis]) -> dict[int, float]:
    """length -> largest absolute entry of the covariance of the whitened fit list minus the identity; covar_pop centres before it multiplies."""
    most = max((len(b.values) for b in bases.values()), default=0)
    if not most:
        return {}
    at: list[Column] = [F.get("w", F.lit(i)) for i in range(most)]
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    rows = _whitened(fit, bases).groupBy("d").agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    return {r.d: max([abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(bases[r.d].values)], default=0.0) for r in rows}


def fit_bases(vectors: DataFrame, shift: int = OFFSET, k: int = COMPONENTS) -> dict[int, Basis]:
    """length -> basis of the distinct vectors in vectors.x."""
    fit = stored(vectors.select("x").distinct(), "fit")
    bases = {d: decompose(*found, k) for d, found in scatter(fit, shift).items()}
    for d, error in identity_errors(fit, bases).items():
        bases[d].identity_error = error
    return bases


def whiten(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET, k: int = COMPONENTS) -> DataFrame:
    """ident, component (from 1), n, deviation (decimal), whitened, explained and identity_error, a row for each vector and component."""
    rows = integers(df, ident, vector, scale, offset)
    bases = fit_bases(rows, offset, k)
    full = T.StructType([T.StructField(ident, rows.schema[ident].dataType), *struct(component=INT, n=LONG, deviation=EXACT, whitened=DOUBLE, explained=DOUBLE, identity_error=DOUBLE).fields])

    def run(batches):
        from decimal import Decimal

        for batch in batches:
            for d, at in _by_length(batch.column(1)):
                basis, taken = bases[d], pa.array(at)
                m = len(basis.values)
                if not m:
                    continue
                deviation, w = project(_matrix(batch.column(1).take(taken)), basis)
                each, all_ = np.repeat(np.arange(len(at)), m), len(at) * m
                exact = pa.array([Decimal(int(v)) if int(v) < 10**38 else None for v in deviation], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(taken).take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))), pa.array(np.full(all_, basis.n)), exact.take(pa.array(each)),
                        pa.array(w.ravel()), pa.array(np.tile(basis.explained, len(at))), pa.array(np.full(all_, basis.identity_error)),
                    ],
                    names=full.names,
                )

    return map_in_arrow(rows, run, full)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
