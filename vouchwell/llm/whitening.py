"""Embedding whitening by LOBPCG (locally optimal block preconditioned conjugate gradients).

The covariance matrix is never formed. A pass over the rows gives its product with a block of
columns: each task centres its rows, multiplies, and brings one small matrix; those are added up in
two levels. Each step solves the small eigenproblem on the span of the iterate, its residuals and the
previous directions (Rayleigh-Ritz), until the wanted residuals are below ``TOLERANCE`` of the largest
eigenvalue; a pass of its own over the final vectors certifies that. Blocks of columns are what
reaches the driver: their size depends on the vectors' width, not on the number of rows.

Edge cases: a vector that is null or holds null or non-finite entries is dropped, as is one whose
width isn't the most frequent one (of equally frequent ones the largest); repeated rows and rows with
equal or null ids are rows like others; components without variance, up to rounding, are not given, so
an empty table, a single row or equal rows give no result; columns beside the vector are kept in
``_rest``. An entry beyond a long's range fails the query, and so does a sum that a long can't hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchwell.llm._shared import materialize, small_batches

COMPONENTS = 32
#: Columns iterated beyond those wanted; they make the wanted ones converge sooner.
GUARD = 8
#: Largest residual, as a share of the largest eigenvalue, at which an eigenvector counts as found.
TOLERANCE = 1e-13
STEPS = 500
#: Eigenvalues below this share of the largest, times the width, are rounding.
ROUNDING = 1e-13
ROWS = 8192


@dataclass
class Whitening:
    """What a fit gives: ``vectors`` (width x components), their eigenvalues, and how sure they are."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def usable(vector: Column) -> Column:
    """Is it a vector of finite numbers?"""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def grid(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """Entries as whole numbers: floor(scale * c) + shift."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("long"))


def usable_rows(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """``x`` (whole numbers) and ``_rest`` of the usable rows, written, and their width."""
    rest = F.struct(F.lit(True).alias("_any"), *[F.col(f"`{c}`") for c in rows.columns if c != vector])
    own = F.col(f"`{vector}`")
    found = materialize(rows.filter(usable(own)).select(grid(own).alias("x"), rest.alias("_rest")), "vectors")
    widths = found.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    top = widths.orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    width = top[0]["width"] if top else 0
    return found.filter(F.size("x") == width), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _partials(kernel, width: int):
    def run(batches):
        total = None
        for batch in small_batches(batches, ROWS):
            own = kernel(_matrix(batch.column("x"), width))
            total = own if total is None else total + own
        if total is not None:
            pid = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["pid", "part"])

    return run


def summed(rows: DataFrame, width: int, kernel, kind: type) -> np.ndarray | None:
    """The sum of ``kernel`` over all rows' matrix, flat: one partial result a task, added up by
    groups of about the root of their number, and those on the driver. Always in the same order."""
    parts = materialize(rows.select("x").mapInArrow(_partials(kernel, width), "pid int, part binary"), "parts")
    groups = max(1, round(parts.count() ** 0.5))

    def add(some):
        some = some.sort_values("pid")
        total = sum(np.frombuffer(p, kind) for p in some["part"])
        return some.head(1).assign(part=[total.tobytes()])

    tops = parts.groupBy(F.pmod("pid", F.lit(groups)).alias("g")).applyInPandas(add, "pid int, part binary").collect()
    found = [np.frombuffer(r["part"], kind) for r in sorted(tops, key=lambda r: r["pid"])]
    return sum(found) if found else None


def product(rows: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sum of centred row times centred row times the block, over all rows (not divided)."""
    d, m = block.shape

    def kernel(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ (centred @ block)

    return summed(rows, d, kernel, np.float64).reshape(d, m)


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the block's part outside ``against``. Columns that depend on others,
    or vanish, go."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        if against is not None and block.shape[1]:
            block = block - against @ (against.T @ block)
        if not block.shape[1]:
            break
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-10 * max(1.0, size[0])]
    return block


def lobpcg(multiply, width: int, wanted: int, tolerance: float = TOLERANCE, steps: int = STEPS, seed: int = 13):
    """The largest eigenpairs of a symmetric positive matrix that ``multiply`` applies to a block:
    values, vectors, the certified residual's share of the largest value, and the steps taken."""
    block = min(width, wanted + GUARD)
    x = orthonormal(np.random.default_rng(seed).standard_normal((width, block)))
    residuals = directions = np.zeros((width, 0))
    for step in range(1, steps + 1):
        w = orthonormal(residuals, x)
        basis = np.hstack([x, w])
        p = orthonormal(directions, basis)
        basis = np.hstack([basis, p])
        image = multiply(basis)
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1][:block], mix[:, ::-1][:, :block]
        directions = basis[:, block:] @ mix[block:]
        x = basis @ mix
        residuals = image @ mix - x * values
        top = max(values[0], np.finfo(float).tiny)
        if np.linalg.norm(residuals[:, :wanted], axis=0).max() <= tolerance * top:
            x = np.linalg.qr(x)[0]  # orthonormal to the last bit
            image = multiply(x[:, :wanted])
            values = np.einsum("ij,ij->j", x[:, :wanted], image)
            sure = np.linalg.norm(image - x[:, :wanted] * values, axis=0).max() / top
            if sure <= 2 * tolerance:
                return values, x[:, :wanted], sure, step
    raise ArithmeticError(f"no eigenvectors after {steps} steps: residual {np.linalg.norm(residuals[:, :wanted], axis=0).max() / top:.1e}")


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of rows with whole numbers ``x``: exact sums, then the eigenvectors."""
    none = Whitening(0, np.zeros(width, np.int64), np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    if width == 0:
        return none
    counted = summed(rows, width, lambda x: np.append(x.sum(axis=0), len(x)), np.int64)
    if counted is None:
        return none
    n, sums = int(counted[-1]), counted[:-1]
    mean = sums / n
    squares = summed(rows, width, lambda x: np.square(x - mean).sum(axis=0), np.float64)
    trace = float(squares.sum()) / n
    if trace == 0:
        return Whitening(n, sums, none.vectors, none.values, 0.0, 0.0, 0)
    wanted = min(components, width)
    values, vectors, residual, steps = lobpcg(lambda block: product(rows, mean, block) / n, width, wanted)
    real = values > ROUNDING * width * values[0]
    values, vectors = values[real], vectors[:, real]
    strongest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[strongest, np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors, values, trace, residual, steps)


def _whiten(model: Whitening):
    mean, scaled, width = model.mean, model.scaled, len(model.sums)

    def run(batches):
        for batch in small_batches(batches, ROWS):
            y = (_matrix(batch.column("x"), width) - mean) @ scaled
            ends = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
            white = pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_rest"), batch.column("x"), white], names=["_rest", "x", "white"])

    return run


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """The rows with ``white``, their coordinates along the model's components."""
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["_rest"].dataType)
    return rows.select("_rest", "x").mapInArrow(_whiten(model), f"_rest struct<{fields}>, x array<bigint>, white array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, computed from them."""
    k = model.vectors.shape[1]
    mean, scaled = model.mean, model.scaled

    def kernel(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ scaled
        return np.vstack([y.T @ y, y.sum(axis=0)]).ravel()

    found = summed(rows, len(model.sums), kernel, np.float64).reshape(k + 1, k) / model.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def deviation(x: Column, sums: np.ndarray, n: int) -> Column:
    """Sum over the dimensions of (n x - S) squared, exact."""
    centre = F.array(*[F.lit(int(s)).cast("long") for s in sums])
    parts = F.zip_with(x, centre, lambda a, s: F.lit(n).cast("long") * a - s)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, d: total + d * d)


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """Per usable row: _rest, white (one coordinate a component), n, deviation, explained (a share
    per component) and identity_error; and the model."""
    found, width = usable_rows(rows, vector)
    model = fit(found, width, components)
    if not len(model.values):
        empty = found.limit(0).select("_rest", F.array().cast("array<double>").alias("white"))
        return empty.select("*", *[F.lit(0).cast(t).alias(c) for c, t in (("n", "long"), ("deviation", "long"))],
                            F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error")), model
    error = identity_error(found, model)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return apply(found, model).select(
        "_rest",
        "white",
        F.lit(model.n).cast("long").alias("n"),
        deviation(F.col("x"), model.sums, model.n).alias("deviation"),
        shares.alias("explained"),
        F.lit(error).alias("identity_error"),
    ), model
