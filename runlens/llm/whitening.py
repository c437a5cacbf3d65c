"""Whitened embeddings with eigenvectors refined in mixed precision.

Vectors become whole numbers, so sums over distinct vectors are exact whatever the order in which tasks
add them up. The covariance is summed as centred outer products. Its eigenvectors are found in float32 and corrected
by the iterations of Ogita and Aishima: matrix products in higher precision measure how far the
vectors are from orthonormal and from diagonalising, and a first-order correction removes both.
Eigenvalues closer to each other than the error bound are treated as a cluster: the correction leaves their
subspace alone but for orthonormality, and a small eigenproblem inside it, shifted by their mean, separates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.staging import staged

SCALE = 256
COMPONENTS = 4
#: A dimensions x dimensions matrix is held by each task and solved on the driver.
MOST_DIMENSIONS = 2048
#: Whole components are below this, so products of two are exact in doubles.
MOST_VALUE = 1 << 25
#: Vectors multiplied at once.
ROWS = 1024
#: Exact sums are carried as high * LIMB + low.
LIMB = 1 << 30
#: Slices of a number in extended-precision products, about 20 bits each.
SLICES = 4
MOST_ROUNDS = 30


def sliced(m: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A matrix as SLICES matrices of whole numbers up to 2 ** bits, each with a unit for every row."""
    most = np.abs(m).max(axis=1, keepdims=True)
    unit = np.ldexp(np.ones_like(most), np.frexp(most)[1] - bits)
    out = []
    for _ in range(SLICES):
        whole = np.rint(m / unit)
        out.append((whole.astype(float), unit))
        m = m - whole * unit
        unit = np.ldexp(unit, -bits)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in extended precision. Both are sliced so that the products of slices are exact in doubles and
    the fast multiplication of doubles can do them."""
    bits = (52 - int(a.shape[1]).bit_length()) // 2
    total = np.zeros((a.shape[0], b.shape[1]), np.longdouble)
    left, right = sliced(a, bits), sliced(b.T, bits)
    for i in reversed(range(SLICES)):
        for j in reversed(range(SLICES - i)):
            (x, u), (y, v) = left[i], right[j]
            total += (x @ y.T).astype(np.longdouble) * u * v.T
    return total


def symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so by two steps of Newton and Schulz."""
    for _ in range(2):
        x = product(x, 1.5 * np.eye(x.shape[1], dtype=np.longdouble) - product(x.T, x) / 2)
    return x


def refined(matrix: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric extended-precision matrix, from
    approximate eigenvectors ``found``. Rounds end when the error bound stops falling."""
    a, x = matrix.astype(np.longdouble), found.astype(np.longdouble)
    d = len(a)
    norm = np.sqrt((a * a).sum())
    before = np.inf
    for _ in range(MOST_ROUNDS):
        off = symmetric(np.eye(d, dtype=np.longdouble) - product(x.T, x))
        seen = symmetric(product(x.T, product(a, x)))
        values = np.diag(seen) / (1 - np.diag(off))
        unsolved = seen - np.diag(values)
        bound = 2 * (np.sqrt((unsolved * unsolved).sum()) + norm * np.sqrt((off * off).sum()))
        if not bound or bound > before / 2:
            break
        before = bound
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > bound
        x = x + product(x, np.where(apart, (seen + values[None, :] * off) / np.where(apart, gap, 1), off / 2))
        for group in clusters(values, bound):
            x[:, group] = separated(a, x[:, group], values[group].mean())
    x = orthonormal(x)
    values = (product(a, x) * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def clusters(values: np.ndarray, bound: np.longdouble) -> list[np.ndarray]:
    """Runs of two or more eigenvalues whose neighbours are within ``bound``."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > bound) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def separated(a: np.ndarray, x: np.ndarray, shift: np.longdouble) -> np.ndarray:
    """The columns of x turned within their span so that they diagonalise a on it. The shift leaves small
    numbers, whose differences doubles can tell."""
    x = orthonormal(x)
    inner = symmetric(product(x.T, product(a, x) - shift * x))
    scale = np.abs(inner).max()
    if not scale:
        return x
    return product(x, np.linalg.eigh((inner / scale).astype(float))[1].astype(np.longdouble))


@dataclass
class Whitening:
    """n distinct vectors with per-dimension sums; falling eigenvalues and unit eigenvectors (columns) of
    their covariance, and its trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        if self.n * MOST_VALUE * 2 < 1 << 62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column for each component: the centred vector along it over the root of its eigenvalue."""
        centred = (self.deviations(x) / self.n).astype(float)
        return centred @ (self.vectors / np.sqrt(self.values))


def whole_vectors(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(SCALE * c) of each entry c; rows whose vector is null, empty or holds a null or
    non-finite entry go. All vectors must have one length and entries below MOST_VALUE / SCALE."""
    kind = T.StructType([T.StructField("vec_id", table.schema[row_id].dataType), T.StructField("x", T.ArrayType(T.LongType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            ids, out = [], []
            for k, vec_id in enumerate(batch.column("vec_id")):
                if not lists[k].is_valid or not len(lists[k]):
                    continue
                entries = lists[k].values.to_numpy(zero_copy_only=False).astype(float)
                if not np.isfinite(entries).all():  # null entries are read as nan
                    continue
                x = np.floor(SCALE * entries)
                if np.abs(x).max() >= MOST_VALUE:
                    raise ValueError(f"entries of {MOST_VALUE // SCALE} or more are beyond this operator")
                ids.append(vec_id), out.append(x.astype(np.int64))
            offsets = np.cumsum([0, *map(len, out)])
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            named = pa.array([i.as_py() for i in ids], batch.schema.field("vec_id").type)
            yield pa.RecordBatch.from_arrays([named, made], names=["vec_id", "x"])

    return table.select(F.col(row_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(whole, kind)


def stacked(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows of a matrix."""
    lists = batch.column("x")
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def exact_sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Count and per-dimension sums; each task tells one row a dimension."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + stacked(batch).sum(axis=0)
        if n:
            d = len(total)
            yield pa.RecordBatch.from_pydict({"i": np.arange(d, dtype=np.int32), "n": np.full(d, n), "s": total})

    rows = fit.mapInArrow(told, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if not rows:
        return 0, np.zeros(0, object)
    return rows[0].n, np.array([r.s for r in sorted(rows, key=lambda r: r.i)], object)


def covariance(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance with divisor n in extended precision.

    Vectors are centred at the whole numbers next to their means before they are multiplied, so products are exact;
    what is left of the mean, less than one, is taken off in whole numbers at the end.
    """
    d = len(sums)
    centre = np.array([int(s) // n for s in sums], np.int64)
    upper = np.triu_indices(d)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(len(upper[0]), np.int64), np.zeros(len(upper[0]), np.int64)
        seen = False
        for batch in batches:
            x = (stacked(batch) - centre).astype(float) if batch.num_rows else np.zeros((0, d))
            most = np.abs(x).max(initial=1)
            step = int(max(1, min(ROWS, 2.0**52 // (most * most))))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                total = (part.T @ part)[upper].astype(np.int64)
                high += total // LIMB
                low += total % LIMB
                seen = True
        if seen:
            i, j = (u.astype(np.int32) for u in upper)
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "high": high, "low": low})

    summed = fit.mapInArrow(told, "i int, j int, high long, low long").groupBy("i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low")
    )
    left = [int(s) - n * int(c) for s, c in zip(sums, centre)]
    out = np.zeros((d, d), np.longdouble)
    for r in summed.toLocalIterator():
        exact = Fraction(n * (r.high * LIMB + r.low) - left[r.i] * left[r.j], n * n)
        out[r.i, r.j] = out[r.j, r.i] = _extended(exact)
    return out


def _extended(exact: Fraction) -> np.longdouble:
    """A fraction as a double and what the double leaves of it."""
    first = float(exact)
    return np.longdouble(first) + np.longdouble(float(exact - Fraction(first)))


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct x of ``vectors``, a written table of one row each; None if nothing varies.

    Components without variance are left out.
    """
    n, sums = exact_sums(vectors)
    if not n:
        return None
    if len(sums) > MOST_DIMENSIONS:
        raise ValueError(f"{len(sums)} dimensions; at most {MOST_DIMENSIONS} fit a driver")
    v = covariance(vectors, n, sums)
    trace = np.trace(v)
    if not trace > 0:
        return None
    scaled = v / trace
    rough = np.linalg.eigh(scaled.astype(np.float32))[1]
    values, found = refined(scaled, rough)
    kept = [k for k in range(min(components, len(values))) if values[k] > 1e-14 * len(values)]
    return Whitening(n, sums, (values[kept] * trace).astype(float), found[:, kept].astype(float), float(trace))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened distinct vectors minus the identity."""
    k = len(model.values)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                y = model.whitened(stacked(batch))
                first, second = first + y.sum(axis=0), second + y.T @ y
        yield pa.RecordBatch.from_pydict({"at": np.arange(k + k * k), "x": np.concatenate([first, second.ravel()])})

    rows = vectors.mapInArrow(told, "at long, x double").groupBy("at").agg((F.sum("x") / model.n).alias("x")).collect()
    told_x = np.array([r.x for r in sorted(rows, key=lambda r: r["at"])])
    mean, square = told_x[:k], told_x[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for each vector and
    component.

    Vectors that are null, empty or hold a null or non-finite entry go. Repeated rows and rows without an id stay,
    each with its own result; equal vectors count once in the fit. Lengths that differ raise an error, as do
    entries of MOST_VALUE / SCALE or more. Components of no variance are left out; where nothing varies, or
    without vectors, there are no rows. Other columns are not read. Signs and, among equal eigenvalues, directions are
    those of one fit, the same for all rows. A deviation beyond 64 bits raises an error.
    """
    rows = staged(whole_vectors(table, row_id, vector), "vectors")
    kind = T.StructType([
        rows.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    lengths = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if lengths.least != lengths.most:
        raise ValueError(f"vectors of {lengths.least} to {lengths.most} entries")
    distinct = staged(rows.select("x").distinct(), "distinct-vectors")
    model = fit_whitening(distinct, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], kind)
    error = identity_error(distinct, model)
    k = len(model.values)
    explained = model.values / model.trace

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = stacked(batch)
            far = model.deviations(x)
            if int(np.abs(far).max()) ** 2 * far.shape[1] >= 1 << 63:
                far = far.astype(object)
            deviation = (far * far).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(np.repeat(np.array(deviation, np.int64), k)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=kind.names,
            )

    return rows.mapInArrow(told, kind)
