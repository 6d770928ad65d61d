"""Principal-component whitening of embeddings, with a covariance that keeps its small digits.

Entries become whole numbers on a lattice (``lattice``), equal vectors count once, and everything up to the
covariance is exact or double-double:

1. ``n`` and the sums S of each dimension, in whole numbers.
2. Centred vectors n * x - S, whole numbers (beyond 62 bits Python's).  An error-free transformation splits them
   into slices of 21 bits, so that the outer products of a block of 1024 rows add up without rounding in
   ordinary matrix products; each block is added to a double-double matrix by two-sums.  Tasks merge their
   high and low parts, a row of the matrix at a time, in two levels.
3. Eigenvectors by reduction to tridiagonal form and divide and conquer (LAPACK's syevd, as numpy's eigh has
   it), refined twice in extended precision against the double-double matrix.
4. Projections of all rows, and of the fitted ones once more to measure how far their covariance is from
   the identity.

What comes to the driver is a few numbers for each dimension and the d * d matrix.

Cases: a vector that is null or empty, or has a null, non-finite or too large entry (``REACH`` lattice
steps or more), is left out, and so are those of another length than most have (of equally frequent
lengths the shorter counts).  Repeated rows are all returned; null vec_ids stay null.  Components without
variance (rounding aside) are left out, so one distinct vector or none gives no rows.  Of equal eigenvalues
any basis will do; a component's largest entry is positive.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import Scratch

#: Lattice steps from 0 that an entry may be away: beyond, it is no 64-bit number.
REACH = 1 << 62
#: Entries up to here can be added up in 64 bits within an Arrow batch.
SUMMED = 1 << 40
#: Bits of a slice, and rows whose products of slices add up below 2 ** 53, also twice.
SLICE, ROWS = 21, 1024
#: Tasks whose matrices are merged in one group.
FAN = 256
MATRIX = "part long, i int, hi array<double>, lo array<double>"


def lattice(embeddings: DataFrame, scale: float = 64.0, shift: int = 1_000_000, column: str = "embedding") -> DataFrame:
    """vec_id and x, an array of floor(scale * entry) + shift, of the vectors that can be used."""
    at = lambda c: c.cast("double") * scale
    fine = F.forall(column, lambda c: c.isNotNull() & F.coalesce(~F.isnan(c) & (F.abs(at(c)) < REACH), F.lit(False)))
    kept = embeddings.where(F.col(column).isNotNull() & (F.size(column) > 0) & fine)
    return kept.select("vec_id", F.transform(column, lambda c: F.floor(at(c)) + shift).alias("x"))


def usual_length(vectors: DataFrame) -> int:
    found = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.d if found else 0


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def two_sum(a, b):
    """a + b without loss: the rounded sum, and what it lacks."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_pairs(hi, lo, x, y=0.0):
    """(hi, lo) + (x, y) in double-double."""
    s, e = two_sum(hi, x)
    t, f = two_sum(lo, y)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def sliced(y: np.ndarray, bits: int) -> list[np.ndarray]:
    """Doubles of at most SLICE bits (and sign) that add up to y with weights 2 ** (SLICE * k)."""
    out = []
    for k in range(-(-bits // SLICE)):
        rest = y >> (SLICE * k)
        out.append((rest if SLICE * (k + 1) >= bits else rest & ((1 << SLICE) - 1)).astype(np.float64))
    return out


def outer_sum(y: np.ndarray, bits: int, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) + the sum of the outer products of the rows of y."""
    for a in range(0, len(y), ROWS):
        parts = sliced(y[a : a + ROWS], bits)
        for p in range(len(parts)):
            for q in range(p, len(parts)):
                product = parts[p].T @ parts[q]  # whole numbers below 2 ** 52: no rounding in any order
                product = product if p == q else product + product.T
                hi, lo = add_pairs(hi, lo, np.ldexp(product, SLICE * (p + q)))
    return hi, lo


@dataclass(frozen=True)
class Center:
    n: int
    #: Sums of each dimension as n * whole + rest, so that centred vectors are n * (x - whole) - rest.
    whole: np.ndarray
    rest: np.ndarray
    bits: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.bits > 62:
            return self.n * (x.astype(object) - self.whole.astype(object)) - self.rest.astype(object)
        return self.n * (x - self.whole) - self.rest


def center(fit: DataFrame, d: int) -> Center | None:
    """n and S of the vectors, None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, np.zeros(d, object), np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for batch in batches:
            x = matrix(batch, d)
            if len(x):
                small = max(-int(x.min()), int(x.max())) < SUMMED and len(x) < 1 << 22
                n, total, low, high = n + len(x), total + (x if small else x.astype(object)).sum(axis=0), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(d, dtype=np.int32), "n": np.full(d, n), "total": pa.array([int(v) for v in total], pa.decimal128(38, 0)), "low": low, "high": high})

    sums = fit.select("x").mapInArrow(run, "i int, n long, total decimal(38,0), low long, high long")
    rows = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.i)
    n = int(rows[0].n)
    whole = [int(r.total) // n for r in rows]
    reach = n * (1 + max(max(r.high - w, w - r.low) for r, w in zip(rows, whole)))
    return Center(n, np.array(whole, np.int64), np.array([int(r.total) - n * w for r, w in zip(rows, whole)], np.int64), reach.bit_length() + 1)


def merged(parts: DataFrame, by: F.Column) -> DataFrame:
    """Rows of matrices of several tasks, added up in double-double, in order of the tasks."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        hi, lo = np.array(pdf.hi.iloc[0]), np.array(pdf.lo.iloc[0])
        for x, y in zip(pdf.hi.iloc[1:], pdf.lo.iloc[1:]):
            hi, lo = add_pairs(hi, lo, np.asarray(x), np.asarray(y))
        return pd.DataFrame({"part": [key[0]], "i": [key[1]], "hi": [hi], "lo": [lo]})

    return parts.groupBy(by.cast("long").alias("to"), "i").applyInPandas(add, MATRIX)


def covariance(fit: DataFrame, d: int, mid: Center) -> np.ndarray:
    """The covariance of x (divisor n), in extended precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hi = lo = np.zeros((d, d))
        for batch in batches:
            hi, lo = outer_sum(mid(matrix(batch, d)), mid.bits, hi, lo)
        if hi.any():
            part = TaskContext.get().partitionId()
            for a in range(0, d, 64):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(hi[a : a + 64]), pa.int64()), "i": pa.array(range(a, min(a + 64, d)), pa.int32()), "hi": list(hi[a : a + 64]), "lo": list(lo[a : a + 64])})

    parts = fit.select("x").mapInArrow(run, MATRIX)
    rows = merged(merged(parts, F.floor(F.col("part") / FAN)), F.lit(0)).collect()
    out = np.zeros((d, d), np.longdouble)
    for r in rows:
        out[r.i] = np.array(r.hi, np.longdouble) + np.array(r.lo, np.longdouble)
    return out / np.longdouble(mid.n) ** 3


def refined(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and -vectors of v nearer to the true ones than x, by one step of correcting x as a whole;
    vectors of eigenvalues that can't be told apart are only made orthogonal."""
    r, s = np.eye(len(v), dtype=v.dtype) - x.T @ x, x.T @ v @ x
    e = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(e)
    apart = e[None, :] - e[:, None]
    near = np.abs(apart) <= 2 * (np.sqrt((off**2).sum()) + np.sqrt((v**2).sum()) * np.sqrt((r**2).sum()))
    return e, x + x @ np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, apart))


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns."""
    _, x = np.linalg.eigh(v.astype(np.float64))
    x = x.astype(v.dtype)
    for _ in range(2):
        _, x = refined(v, x)
    x = x / np.sqrt((x**2).sum(axis=0))
    e = ((v @ x) * x).sum(axis=0)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > 8 * len(v) * np.finfo(v.dtype).eps * e.max()] if len(order) else order
    x = x[:, order]
    return e[order], x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)


@dataclass(frozen=True)
class Whitening:
    center: Center
    d: int
    #: Unit vectors over the roots of their eigenvalues, as columns.
    axes: np.ndarray
    #: Share of the whole variance.
    explained: np.ndarray

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y / self.center.n).astype(np.float64) @ self.axes


def fit_whitening(fit: DataFrame, d: int, most: int = 16) -> Whitening | None:
    """Of distinct vectors x of length d, a written table: it is read three times."""
    mid = center(fit, d) if d else None
    if mid is None:
        return None
    v = covariance(fit, d, mid)
    if not v.any():
        return None
    e, x = components(v, most)
    return Whitening(mid, d, (x / np.sqrt(e)).astype(np.float64), (e / np.trace(v)).astype(np.float64))


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    k = w.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            z = w.project(w.center(matrix(batch, w.d)))
            total += np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))
        yield pa.RecordBatch.from_pydict({"i": np.arange(k + k * k), "total": total})

    rows = fit.select("x").mapInArrow(run, "i long, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(k + k * k)
    for r in rows:
        total[r.i] = r.total / w.center.n
    mean, square = total[:k], total[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, most: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """A row for each vector that can be used and each component: vec_id, component (from 1), n (distinct
    vectors), deviation (squared length of n * x - S, exact; null from 10 ** 38), whitened, explained,
    identity_error."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spark, rows = embeddings.sparkSession, lattice(embeddings, scale, shift)
    d = usual_length(rows)
    rows = rows.where(F.size("x") == d)
    fit = Scratch(spark).write(rows.select("x").distinct(), "fit")
    w = fit_whitening(fit, d, most)
    if w is None:
        return spark.createDataFrame([], schema)
    error, k, n = identity_error(fit, w), w.axes.shape[1], w.center.n
    small = 2 * (w.center.bits - 1) + d.bit_length() < 63  # squares add up in 64 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                y = w.center(matrix(part, d))
                z = w.project(y)
                if small:
                    deviation = pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    exact = [sum(v * v for v in row) for row in y.tolist()]
                    deviation = pa.array([v if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                row = pa.array(np.repeat(np.arange(len(y)), k))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column("vec_id").take(row),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                        "n": pa.array(np.full(len(row), n)),
                        "deviation": deviation.take(row),
                        "whitened": pa.array(z.ravel()),
                        "explained": pa.array(np.tile(w.explained, len(y))),
                        "identity_error": pa.array(np.full(len(row), error)),
                    }
                )

    return rows.mapInArrow(run, schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
