"""Embedding whitening: the leading eigenvectors of the covariance by LOBPCG, and rows projected on them to unit variance.

The covariance is never formed. A product of it with a block of directions is one pass over the centred rows: tasks add
up z (z' B), Spark adds up the tasks, and the driver keeps blocks of a vector's length. Each step takes Rayleigh and Ritz's
best combination of the iterate, its residuals and the directions of the step before. Steps end when the residuals of the
wanted components, with a product taken afresh, are as small as double precision lets them be.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import blocks, kept_vectors, summed

COMPONENTS, GUARD, SEED, MOST_STEPS = 8, 8, 20250, 200
#: What is added to an entry's steps, so that they are above zero.
SHIFT = 100_000
#: Residuals, by the largest eigenvalue: what is striven for, and what a result must have.
AIM, CERTIFIED = 1e-14, 1e-11
#: A component whose eigenvalue is this part of the largest, or less, is none: rows don't vary along it.
FLAT = 1e-9


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    steps: int
    identity_error: float = 0.0


def _totals(dim: int):
    total = np.zeros(dim + 1, np.int64)

    def add(batch: pa.RecordBatch) -> None:
        for _, q in blocks(batch, dim):
            total[:dim] += (q + SHIFT).sum(0)
            total[dim] += len(q)

    return add, total


def _off(q: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n times a row's distance from the mean, exact."""
    return n * (q + SHIFT) - sums


def _products(n: int, sums: np.ndarray, block: np.ndarray):
    """Of the covariance and a block, times n; the last row has the squared rows' sum, for the trace."""
    total = np.zeros((len(sums) + 1, block.shape[1]))

    def add(batch: pa.RecordBatch) -> None:
        for _, q in blocks(batch, len(sums)):
            z = _off(q, n, sums) / n
            total[:-1] += z.T @ (z @ block)
            total[-1, 0] += (z * z).sum()

    return add, total


def _outer(w: Whitening):
    total = np.zeros((len(w.values) + 1, len(w.values)))

    def add(batch: pa.RecordBatch) -> None:
        for _, q in blocks(batch, len(w.sums)):
            y = project(q, w)
            total[:-1] += y.T @ y
            total[-1] += y.sum(0)

    return add, total


def project(q: np.ndarray, w: Whitening) -> np.ndarray:
    return (_off(q, w.n, w.sums) / w.n) @ w.vectors / np.sqrt(w.values)


def _fresh(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block's columns, each at unit length, have beyond `against`."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-300] / size[size > 1e-300]
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-8][:, : against.shape[0] - against.shape[1]]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


def lobpcg(product, dim: int, wanted: int, guard: int = GUARD, seed: int = SEED, most_steps: int = MOST_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Largest eigenvalues, eigenvectors, residual norms and steps, of the symmetric matrix whose product with a block product() gives.

    Residuals of the wanted ones are measured with a fresh product. Where they stay above CERTIFIED of the largest
    eigenvalue after most_steps steps, it ends with an error.
    """
    m = min(dim, wanted + guard)
    wanted = min(wanted, m)

    def rotated(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = basis.T @ image
        values, c = np.linalg.eigh((h + h.T) / 2)
        return values[::-1][:m], c[:, ::-1][:, :m]

    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, m)))[0]
    image, past, fresh = product(x), np.zeros((dim, 0)), True
    values, c = rotated(x, image)
    x, image = x @ c, image @ c
    best, since = None, 0
    for step in range(1, most_steps + 1):
        rest = image - x * values
        sizes = np.linalg.norm(rest[:, :wanted], axis=0)
        scale = max(abs(values[0]), 1e-300)
        if fresh:
            since = 0 if best is None or sizes.max() < 0.5 * best[2].max() else since + 1
            best = (values, x, sizes) if best is None or sizes.max() < best[2].max() else best
            if sizes.max() <= AIM * scale or (since > 1 and best[2].max() <= CERTIFIED * scale):
                break
        beyond = _fresh(np.hstack((rest, past)), x)
        if not beyond.shape[1] or (sizes.max() <= CERTIFIED * scale and not fresh):
            x = np.linalg.qr(x)[0]
            image, fresh = product(x), True
            values, c = rotated(x, image)
            x, image = x @ c, image @ c
            continue
        basis, images = np.hstack((x, beyond)), np.hstack((image, product(beyond)))
        values, c = rotated(basis, images)
        past = beyond @ c[m:]
        x, image, fresh = basis @ c, images @ c, False
    values, x, sizes = best
    if sizes.max() > CERTIFIED * max(abs(values[0]), 1e-300):
        raise ArithmeticError(f"residuals of {sizes.max() / values[0]:.1e} of the largest eigenvalue after {step} steps")
    return values[:wanted], x[:, :wanted], sizes, step


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows (q: steps of each entry); None for no rows, or none that differ. Components whose eigenvalue is FLAT of the largest or less are left out."""
    total = summed(rows, partial(_totals, dim), "long")
    n, sums = int(total[-1]), total[:-1]
    if not n or not dim:
        return None
    if n * int(max(abs(sums)) // n + (1 << 27)) >= 1 << 62:
        raise OverflowError("too many rows for exact sums in longs")
    trace = 0.0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal trace
        out = summed(rows, partial(_products, n, sums, block), "double") / n
        trace = out[-1, 0]
        return out[:-1]

    values, vectors, residuals, steps = lobpcg(product, dim, components)
    if trace <= 0:
        return None
    stay = values > FLAT * values[0]
    w = Whitening(n, sums, values[stay], vectors[:, stay], trace, residuals[stay], steps)
    outer = summed(rows, partial(_outer, w), "double") / n
    w.identity_error = float(np.abs(outer[:-1] - np.outer(outer[-1], outer[-1]) - np.eye(len(w.values))).max())
    return w


def _deviations(off: np.ndarray) -> list[int | None]:
    """Exact sums of squares of a row; None beyond a long."""
    if (off.astype(np.float64) ** 2).sum(1).max(initial=0) < 2.0**62:
        return (off * off).sum(1).tolist()
    exact = [sum(x * x for x in r) for r in off.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def whitened(rows: DataFrame, w: Whitening) -> DataFrame:
    """(key, deviation, values: array of whitened components) of each row, in the order of falling eigenvalues."""
    key = rows.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            deviations, values = [], []
            for _, q in blocks(batch, len(w.sums)):
                deviations += _deviations(_off(q, w.n, w.sums))
                values.append(project(q, w))
            flat = np.concatenate(values).ravel() if values else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(w.values), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), pa.array(deviations, pa.int64()), lists], names=["key", "deviation", "values"])

    return rows.mapInArrow(run, f"key {key}, deviation long, values array<double>")


def op11(embeddings: DataFrame) -> DataFrame:
    """The contract's columns over the whole table, one row for each kept vector and component.

    kept_vectors tells which rows go. Repeated vectors count each time, and null or repeated ids stay. A table without rows,
    or whose rows are all equal, has no component and gives no rows; one whose rows vary along fewer directions than 8
    has as many components. deviation is null where it is beyond a long.
    """
    rows, dim = kept_vectors(embeddings, "vec_id", "embedding")
    w = fit(rows, dim)
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        return embeddings.sparkSession.createDataFrame([], schema.format(embeddings.schema["vec_id"].dataType.simpleString()))
    shares = F.array(*[F.lit(float(v / w.trace)) for v in w.values])
    d = whitened(rows, w).select(F.col("key").alias("vec_id"), "deviation", F.posexplode("values").alias("_k", "whitened"))
    return d.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_k")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))
