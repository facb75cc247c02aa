"""Operator 11, embedding whitening: the principal components of integer vectors from an exact scatter matrix.

Entries become integers, so that their scatter is an integer matrix. Every
partition multiplies its centred vectors modulo several primes, small enough for
products and sums in doubles to be exact; Spark adds the residues, and Chinese
remaindering puts the sums together. How many primes there are follows from a
bound of the scatter, so that nothing can wrap around. The matrix then goes, as
correctly rounded doubles, through a symmetric eigendecomposition in double
precision. Only sums, one matrix of the vectors' width and the components are
ever held by the driver.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows of one product; with residues under 2**21 its sums stay under 2**53.
STEP_ROWS = 2048
PRIME_BITS = 21
#: Components with a smaller share of the largest eigenvalue, times the width, are rounding.
RANK_SHARE = 1e-14


def primes(n: int, bits: int = PRIME_BITS) -> list[int]:
    """The ``n`` largest primes below 2**bits."""
    out, x = [], (1 << bits) - 1
    while len(out) < n:
        if all(x % d for d in range(3, math.isqrt(x) + 1, 2)):
            out.append(x)
        x -= 2
    return out


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size that has these residues."""
    whole = math.prod(moduli)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, moduli, strict=True)) % whole
    return x - whole if 2 * x > whole else x


def integers(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows of ``width`` finite entries, and these as integers, floor(SCALE * c) + SHIFT; without a width, of the rows that could be used their numbers and widths."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    scaled = np.floor(values * SCALE)
    bad = np.append(0, np.cumsum(~(np.abs(scaled) < 2.0**62)))
    ends = np.cumsum(sizes)
    usable = (bad[ends] == bad[ends - sizes]) & (sizes > 0)
    if width is None:
        rows = np.flatnonzero(usable)
        return rows, sizes[rows]
    rows = np.flatnonzero(usable & (sizes == width))
    at = (ends - sizes)[rows][:, None] + np.arange(width)
    return rows, scaled[at].astype(np.int64) + SHIFT


def steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows, x) of at most STEP_ROWS rows each."""
    for b in batches:
        for first in range(0, len(b), STEP_ROWS):
            part = b.slice(first, STEP_ROWS)
            rows, x = integers(part.column("v"), width)
            if len(rows):
                yield part, rows, x


def residue_rows(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n * x - sums modulo p, as doubles."""
    return ((x % p * (n % p) - np.array([s % p for s in sums], np.int64)) % p).astype(np.float64)


@dataclass
class Whitening:
    """The fit: ``n`` vectors with sums ``sums``, unit eigenvectors as columns of ``vectors``, their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, over the roots of their eigenvalues; nan for a component without variance."""
        quotient = [divmod(s, self.n) for s in self.sums]
        # x minus the whole part of the mean is exact, as both are integers.
        centred = (x - np.array([q for q, _ in quotient], np.int64)).astype(np.float64) - np.array([r / self.n for _, r in quotient])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.vectors / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(narrow, wide): the exact sum over dimensions of (n * x - sums)**2; wide only where it doesn't fit 63 bits."""
        reach = max(max(self.n * h - s, s - self.n * w) for h, w, s in zip(self.high, self.low, self.sums, strict=True))
        if reach * reach * self.width < 1 << 63 and self.n * max(map(abs, (*self.low, *self.high))) < 1 << 63:
            y = x * self.n - np.array(self.sums, np.int64)
            return (y * y).sum(1), [None] * len(x)
        sums = np.array(self.sums, object)
        exact = [int(d) for d in ((x.astype(object) * self.n - sums) ** 2).sum(1)]
        return np.array([d if d < 1 << 63 else -1 for d in exact], np.int64), [None if d < 1 << 63 else d for d in exact]


def _widths(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, n = np.unique(integers(b.column("v"), None)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(width.astype(np.int64)), pa.array(n.astype(np.int64))], ["width", "n"])

    return rows.mapInArrow(count, "width long, n long").groupBy("width").agg(F.sum("n").alias("n"))


def _sums(rows: DataFrame, width: int) -> DataFrame:
    """(dim, total, low, high) of the integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = [0] * width, None, None
        for _, _, x in steps(batches, width):
            # Two halves, so that no sum of a step wraps around.
            total = [t + (int(u) << 31) + int(d) for t, u, d in zip(total, (x >> 31).sum(0), (x & ((1 << 31) - 1)).sum(0), strict=True)]
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([decimal.Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(low), pa.array(high)], ["dim", "total", "low", "high"])

    found = rows.mapInArrow(add, "dim int, total decimal(38,0), low long, high long")
    return found.groupBy("dim").agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim")


def _scatter(rows: DataFrame, n: int, sums: list[int], moduli: list[int]) -> DataFrame:
    """(cell, prime, residue): sums over partitions of the centred products modulo each prime, of the matrix's upper half."""
    width = len(sums)
    upper = np.triu_indices(width)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((width, width), np.int64) for _ in moduli]
        for _, _, x in steps(batches, width):
            for i, p in enumerate(moduli):
                y = residue_rows(x, n, sums, p)
                held[i] = (held[i] + (y.T @ y).astype(np.int64)) % p
        cells = np.arange(len(upper[0]), dtype=np.int32)
        for i, m in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(cells), i, np.int32)), pa.array(m[upper])], ["cell", "prime", "residue"])

    return rows.mapInArrow(multiply, "cell int, prime int, residue long").groupBy("cell", "prime").agg(F.sum("residue").alias("residue"))


def _eigen(scatter: list[int], n: int, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, trace) of scatter / n**3, by falling value; values that are rounding are 0."""
    v = np.zeros((width, width))
    wide = np.zeros((width, width), np.longdouble)
    for i, j, s in zip(*np.triu_indices(width), scatter, strict=True):
        v[i, j] = v[j, i] = float(Fraction(s, n**3))
        wide[i, j] = wide[j, i] = np.longdouble(v[i, j]) + np.longdouble(float(Fraction(s, n**3) - Fraction(v[i, j])))
    _, vectors = np.linalg.eigh(v)
    vectors = vectors[:, ::-1]
    # Rayleigh quotients are right to the square of the vectors' error, so small eigenvalues are too.
    q = vectors.astype(np.longdouble)
    values = ((wide @ q) * q).sum(0) / (q * q).sum(0)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order].astype(np.float64), vectors[:, order]
    trace = float(sum((Fraction(scatter[k], n**3) for k, (i, j) in enumerate(zip(*np.triu_indices(width), strict=True)) if i == j), Fraction(0)))
    values[values <= RANK_SHARE * width * max(values[0], 0.0)] = 0.0
    return values, vectors, trace


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors (see ``whiten``); None without any."""
    rows = vectors.select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    widths = _widths(rows).orderBy(F.desc("n"), F.desc("width")).first()
    if widths is None:
        return None
    width, n = int(widths["width"]), int(widths["n"])
    dims = _sums(rows, width).collect()
    sums, low, high = ([int(r[c]) for r in dims] for c in ("total", "low", "high"))
    # No centred entry is larger than n times its dimension's range, so no sum of products than this.
    bound = n * max(n * (h - w) for h, w in zip(high, low, strict=True)) ** 2
    moduli = primes(1)
    while math.prod(moduli) <= 2 * bound:
        moduli = primes(len(moduli) + 1)
    cells = width * (width + 1) // 2
    residues = [[0] * len(moduli) for _ in range(cells)]
    for r in _scatter(rows, n, sums, moduli).collect():
        residues[r["cell"]][r["prime"]] = int(r["residue"]) % moduli[r["prime"]]
    scatter = [remaindered(r, moduli) for r in residues]
    values, found, trace = _eigen(scatter, n, width)
    return Whitening(n, sums, low, high, found[:, :components], values[:components], trace)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance; None if there is none.

    Each step centres its rows on its own mean before it multiplies; means and
    products of all steps then join exactly as if there were one mean.
    """
    k = int((model.values > 0).sum())
    if not k:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for _, _, x in steps(batches, model.width):
            w = model.whitened(x)[:, :k]
            own = w.mean(0)
            gap = own - mean
            products += (w - own).T @ (w - own) + np.outer(gap, gap) * (n * len(w) / (n + len(w)))
            n += len(w)
            mean = mean + gap * (len(w) / n)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])], ["n", "mean", "products"])

    parts = rows.mapInArrow(moments, "n long, mean array<double>, products array<double>")
    total = model.n
    means = parts.select(*(F.sum(F.col("n") * F.col("mean")[i]) / total for i in range(k))).first()
    gap = [F.col("mean")[i] - F.lit(float(means[i])) for i in range(k)]
    entry = lambda i, j: F.sum(F.col("products")[i * k + j] + F.col("n") * gap[i] * gap[j]) / total
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = parts.select(*(entry(i, j) for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_wide) of every usable vector and component, which count from 1.

    Null vectors, empty ones, and those with a null or non-finite entry, or one
    whose integer would need over 62 bits, are dropped; of several widths the
    commonest counts, then the larger. Repeated rows count each. A component
    without variance has no whitened value (null) and none of the identity error.
    A deviation over 63 bits is null, and stands in deviation_wide. No usable
    vector gives no row. Other columns are not read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    schema = rows.select("id").schema
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"), ("deviation_wide", "decimal(38,0)")):
        schema = schema.add(name, kind)
    model = fit(vectors, vector_col, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error = identity_error(rows.select("v"), model)
    k = len(model.values)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kept, x in steps(batches, model.width):
            m = len(kept)
            narrow, wide = model.deviation(x)
            again = np.repeat(np.arange(m), k)
            over = np.array([w is not None for w in wide], bool)
            columns = [
                part.column("id").take(pa.array(np.repeat(kept, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n, np.int64)),
                pa.array(narrow[again], mask=over[again]),
                pa.array(model.whitened(x).ravel(), from_pandas=True),
                pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * k), pa.float64()),
                pa.array([None if w is None else decimal.Decimal(w) for w in wide], pa.decimal128(38, 0)).take(pa.array(again)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)
