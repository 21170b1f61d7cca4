"""Whitening of embeddings: covariance on Spark, its components by spectral divide and conquer, whitening by broadcast.

Components become whole numbers x = floor(scale * component). The covariance is fitted on each different vector once:
exact sums first, then products of centred vectors, added up inside each task and then by row of the matrix. The
polar factor U of the covariance less a shift, by dynamically weighted Halley iterations with QR decompositions
(QDWH), gives the projector (I + U) / 2 on the subspace of eigenvalues above the shift. The matrix is restricted to
that subspace and to its complement, and both are split on until single components are left; a part
in which none of the wanted components can lie is not split.

Defined results: rows whose vector is null or empty, holds null or non-finite entries, or has another length than the
commonest (of equally common the longest) are dropped; ids play no part, so rows with null or repeated ids stay;
components without variance (to rounding) are left out, so that fewer than ``components`` may come, and one vector
alone gives no row; equal eigenvalues give some orthonormal basis of their space; an empty table gives no rows.
Numbers, and deviations that no long can hold, are held at a long's ends.

Scale: the list of different vectors is made by one shuffle with partial aggregation, so copies do not gather. What
leaves a task is a row for each dimension; the driver holds a square matrix of the dimensions
(``most_dims`` at most) and broadcasts a few rows of it. Rows are whitened in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, finite, whole_numbers

EPS = np.finfo(float).eps
LARGEST = (1 << 63) - 1


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH."""
    n, eye = len(a), np.eye(len(a))
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    r = np.linalg.qr(x, mode="r")
    with np.errstate(all="ignore"):
        try:
            low = 1 / np.linalg.norm(np.linalg.solve(r, eye))
        except np.linalg.LinAlgError:
            low = 0.0
    low = min(1.0, max(low, EPS)) if np.isfinite(low) else EPS
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        weight_a = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        weight_b = (weight_a - 1) ** 2 / 4
        weight_c = weight_a + weight_b - 1
        before = x
        if weight_c > 100:
            q = np.linalg.qr(np.vstack((np.sqrt(weight_c) * x, eye)))[0]
            x = weight_b / weight_c * x + (weight_a - weight_b / weight_c) / np.sqrt(weight_c) * q[:n] @ q[n:].T
        else:
            x = weight_b / weight_c * x + (weight_a - weight_b / weight_c) * np.linalg.solve(eye + weight_c * x @ x, x)
        x = (x + x.T) / 2
        low = min(1.0, low * (weight_a + weight_b * square) / (1 + weight_c * square))
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(5 * EPS):
            break
    return x


def split_spectrum(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """(basis, k): an orthonormal basis whose first ``k`` vectors span the eigenvalues above some shift, the others the rest."""
    n, size = len(a), np.linalg.norm(a)
    mean, spread = np.trace(a) / n, np.sqrt(max(0.0, (a * a).sum() / n - (np.trace(a) / n) ** 2))
    best = None
    # the median balances the parts; the mean lies between the extreme eigenvalues; a shift that hits one is moved
    for shift in (np.median(np.diag(a)), mean, *(mean + spread * rng.uniform(-0.5, 0.5, 6))):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = np.linalg.qr(projector @ rng.standard_normal((n, k)))[0]
        basis = np.linalg.qr(projector @ basis, mode="complete")[0]
        left_over = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left_over < best[0]:
            best = left_over, basis, k
        if left_over <= 10 * n * EPS * size:
            break
    if best is None:
        raise ArithmeticError("no shift divides the spectrum")
    return best[1], best[2]


def principal_components(a: np.ndarray, wanted: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    rng, whole = np.random.default_rng(seed), np.linalg.norm(a)

    def divide(part: np.ndarray, basis: np.ndarray, wanted: int) -> tuple[list[float], list[np.ndarray]]:
        n = len(part)
        apart = part - np.diag(np.diag(part))
        if n == 1 or np.linalg.norm(apart) <= EPS * whole or np.linalg.norm(part - np.trace(part) / n * np.eye(n)) <= 4 * n * EPS * whole:
            order = np.argsort(-np.diag(part), kind="stable")[:wanted]
            return np.diag(part)[order].tolist(), [basis[:, i] for i in order]
        turn, k = split_spectrum(part, rng)
        values, vectors = [], []
        for side in (turn[:, :k], turn[:, k:]):
            if len(values) < wanted:
                inner = side.T @ part @ side
                more = divide((inner + inner.T) / 2, basis @ side, wanted - len(values))
                values, vectors = values + more[0], vectors + more[1]
        return values, vectors

    vectors = np.array(divide((a + a.T) / 2, np.eye(len(a)), min(wanted, len(a)))[1]).T
    vectors = np.linalg.qr(vectors)[0]
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n * x - S)^2, exact, held at a long's end."""
    most = n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, sums))
    if most * most * x.shape[1] <= LARGEST:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
    apart = n * x.astype(object) - np.array(sums, object)
    return np.array([min(LARGEST, v) for v in (apart * apart).sum(1)], np.int64)


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", most_dims: int = 8192) -> DataFrame:
    """A row for each usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).where(finite(F.col("v")))
    result = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], result)
    dims = lengths["d"]
    if dims > most_dims:
        raise ValueError(f"vectors of {dims} components; the matrix is kept for {most_dims} at most")
    rows = rows.where(F.size("v") == dims).select("vec_id", whole_numbers(F.col("v"), scale).alias("x"))
    fit = checkpointed(rows.select("x").distinct())

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def summed(batches):
        # two halves, so that sums of any longs are exact
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([(x >> 32).sum(0)]), pa.array([(x & 0xFFFFFFFF).sum(0)])], names=["n", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    partial = fit.mapInArrow(summed, "n long, high array<bigint>, low array<bigint>")
    by_place = partial.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("place", "s")).groupBy("place").agg(F.sum("n").alias("n"), whole("s.high").alias("high"), whole("s.low").alias("low"))
    totals = by_place.orderBy("place").collect()
    n, sums = totals[0]["n"], [(int(t["high"]) << 32) + int(t["low"]) for t in totals]
    mean = np.array([s / n for s in sums])

    def multiplied(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            y = matrix(batch.column("x")) - mean
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(list(total))], names=["place", "products"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(dims)
        for row in table.column("products"):
            total += row.values.to_numpy()
        return pa.table({"place": table.column("place")[:1], "products": pa.array([total])})

    products = fit.mapInArrow(multiplied, "place int, products array<double>").groupBy("place").applyInArrow(added, "place int, products array<double>").orderBy("place").collect()
    covariance = np.array([p["products"] for p in products]) / n
    values, axes = principal_components(covariance, components)
    real = values > dims * EPS * max(float(np.trace(covariance)), 0.0)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return spark.createDataFrame([], result)
    shares, turn = values / np.trace(covariance), axes / np.sqrt(values)
    names = [f"w{i}" for i in range(len(values))]

    def project(batches):
        for batch in batches:
            w = (matrix(batch.column("x")) - mean) @ turn
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(len(names))], names=names)

    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = fit.mapInArrow(project, ", ".join(f"{c} double" for c in names)).agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def whitened(batches):
        count = len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            each = pa.array(np.repeat(np.arange(len(x)), count))
            columns = [
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * count, n)),
                pa.array(np.repeat(deviations(x, n, sums), count)), pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(x) * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(whitened, result)
