"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz.

The covariance is never formed.  One pass over all rows gives exact sums, each further one the product of the
covariance with a thin block of vectors, centred before multiplying and summed over partitions:

1. a random block of ``components + OVERSAMPLE`` columns is multiplied, orthonormalised and multiplied again (power
   passes); every product also gives Rayleigh-Ritz pairs and how far they are from being eigenpairs, without a pass of its own;
2. passes go on while the residuals, falling at the rate seen, can still reach ``TOLERANCE`` within ``PASSES``;
3. if not (eigenvalues close together), the block is filled up to an orthonormal basis of all dimensions.  Of that one
   product Rayleigh-Ritz is exact.

Only sums cross the driver: a vector and a matrix of dimensions by columns, whatever the number of rows.  The
rows are read anew in every pass and nothing of them is kept, so a lost executor costs its part of one pass.

Entries become whole numbers x = floor(scale c) + shift first, so that sums and squared deviations are exact.

Defined results: a row is left out if its vector is null, empty, or holds null, non-finite or very large entries (whose x
would need more than 52 bits), or is of another length than most rows (of lengths equally frequent the greater counts);
components without variance (eigenvalue at most 1e-13 of the trace) are not returned, so a table of equal rows, or of one,
has no rows; a squared deviation beyond 64 bits is null; repeated rows count as often as they occur; rows without a vec_id are rows like
others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, OVERSAMPLE, PASSES, SEED = 8, 8, 6, 12
SCALE, SHIFT = 1024, 100_000

#: Residual of an eigenpair, relative to the greatest eigenvalue, that counts as none.
TOLERANCE = 1e-14

#: Rows of a batch that are multiplied at a time; bounds a worker's memory.
ROWS = 8_192


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # exact sums of x by dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float
    full: bool  # whether all dimensions were needed

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n


def _whole(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are valid (and have ``dims`` entries) and, if ``dims`` is given, the x of those."""
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    size[column.is_null().to_numpy(zero_copy_only=False)] = 0
    values = column.flatten()
    entries = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # a null becomes NaN
    with np.errstate(invalid="ignore", over="ignore"):
        fine = np.abs(entries) < 2.0**52 / SCALE
    bad = np.concatenate([[0], np.cumsum(~fine)])
    ends = np.cumsum(size)
    valid = (size > 0) & (bad[ends] == bad[ends - size])
    if dims is None:
        return np.where(valid, size, 0), np.empty(0)
    valid &= size == dims
    at = (ends - size)[valid][:, None] + np.arange(dims)
    return valid, np.floor(SCALE * entries[at]).astype(np.int64) + SHIFT


def _summed(rows: DataFrame, dims: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of(x)``, a ``(dims, width)`` matrix of each block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                valid, x = _whole(batch.column("embedding").slice(a, ROWS), dims)
                if valid.any():
                    total = of(x) if total is None else total + of(x)
        if total is not None:
            cell = np.arange(dims * width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel())], names=["cell", "value"])

    kind = "long" if of(np.zeros((1, dims), np.int64)).dtype.kind == "i" else "double"
    parts = rows.select("embedding").mapInArrow(run, f"cell int, value {kind}")
    out = np.zeros(dims * width, np.int64 if kind == "long" else np.float64)
    for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():  # a row for each cell of the matrix
        out[r.cell] = r.value
    return out.reshape(dims, width)


def _dims(rows: DataFrame) -> tuple[int, int]:
    """The most frequent length of valid vectors and how many have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, count = np.unique(_whole(batch.column("embedding"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(count.astype(np.int64))], names=["size", "n"])

    counted = rows.select("embedding").mapInArrow(run, "size long, n long").filter("size > 0").groupBy("size").agg(F.sum("n").alias("n"))
    best = counted.orderBy(F.desc("n"), F.desc("size")).first()
    return (best.size, best.n) if best else (0, 0)


def _ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and residual norms of an orthonormal basis and its product with the matrix."""
    small = basis.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading eigenpairs of the covariance of ``rows(embedding)``; None without a valid row."""
    rows = rows.select(F.col("embedding").cast("array<double>").alias("embedding"))
    dims, n = _dims(rows)
    if not n:
        return None
    sums = _summed(rows, dims, 1, lambda x: x.sum(0)[:, None])[:, 0]
    mean = sums / n

    def product(block: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times a block, and the covariance's trace."""

        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return np.concatenate([centred.T @ (centred @ block), (centred**2).sum(0)[:, None]], axis=1)

        summed = _summed(rows, dims, block.shape[1] + 1, of) / n
        return summed[:, :-1], float(summed[:, -1].sum())

    wanted, width = min(components, dims), min(components + OVERSAMPLE, dims)
    draw = np.random.default_rng(SEED)
    basis = np.linalg.qr(draw.standard_normal((dims, width)))[0]
    values = vectors = trace = None
    before, full = np.inf, width == dims
    for k in range(PASSES):
        multiplied, trace = product(basis)
        values, vectors, residuals = _ritz(basis, multiplied)
        worst = residuals[:wanted].max() / max(values[0], np.finfo(float).tiny)
        if full or worst <= TOLERANCE:
            break
        rate = worst / before
        left = PASSES - 1 - k
        before = worst
        if k and not (rate < 1 and worst * rate**left <= TOLERANCE) or not left:
            # Residuals will not vanish: all dimensions, beginning with what was found.
            basis = np.linalg.qr(np.concatenate([vectors, draw.standard_normal((dims, dims - width))], axis=1))[0]
            values, vectors, residuals = _ritz(basis, product(basis)[0])
            full = True
            break
        basis = np.linalg.qr(multiplied)[0]
    real = np.flatnonzero(values[:wanted] > 1e-13 * trace) if trace > 0 else np.empty(0, np.int64)
    vectors = vectors[:, real]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(real))]) if len(real) else 1.0
    return Whitening(n, sums, values[real], vectors * sign, trace, full)


def _projected(model: Whitening) -> np.ndarray:
    return model.vectors / np.sqrt(model.values)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    rows = rows.select(F.col("embedding").cast("array<double>").alias("embedding"))
    k, dims, mean, turn = len(model.values), len(model.sums), model.mean, _projected(model)
    if not k:
        return 0.0

    def of(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ turn
        out = np.zeros((dims, k + 1))
        out[:k, :k], out[:k, k] = white.T @ white, white.sum(0)
        return out

    total = _summed(rows, dims, k + 1, of)[:k]
    centre = total[:, k:] / model.n
    return float(np.abs(total[:, :k] / model.n - centre @ centre.T - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``(vec_id, deviation, whitened)`` of every valid row: the squared deviation of n x from the sums, and all components."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    dims, n, sums, mean, turn = len(model.sums), model.n, model.sums, model.mean, _projected(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                valid, x = _whole(part.column("embedding"), dims)
                white = (x - mean) @ turn
                # Exact in 64 bits unless the sum would not fit; then it is null.
                rough = (n * (x - mean)) ** 2
                fits = rough.sum(1) < 2.0**62
                exact = ((n * x - sums) ** 2).sum(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * turn.shape[1]), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").filter(pa.array(valid)), pa.array(exact, mask=~fits), lists], names=["vec_id", "deviation", "whitened"])

    wanted = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return wanted.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def report(rows: DataFrame) -> DataFrame:
    """A row for each valid vector and component, with the model's figures."""
    model = fit(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if model is None:
        empty = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained.cast("array<double>"), F.col("place")).alias("explained"),
        F.lit(identity_error(rows, model)).alias("identity_error"),
    )
