"""Vector measures over ``array<float>`` or ``array<double>`` columns.

Arrow batches with numpy: on 768-wide vectors this measured more than twice as
fast as ``zip_with`` and ``aggregate``, which are interpreted per element. A
NULL vector, a NULL element, two lengths that differ and an undefined cosine
all give NULL, so one bad row never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, all ``width`` long, as a dense float64 matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(vectors), width)


def lengths(vectors: pa.Array) -> np.ndarray:
    """List lengths, -1 for NULL."""
    return vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~np.isfinite(values))


def rowwise(kernel: Kernel, a: pa.Array, b: pa.Array) -> pa.Array:
    """Apply ``kernel`` to aligned rows, one dense block per vector length."""
    sizes = lengths(a)
    fits = (sizes == lengths(b)) & (sizes > 0)
    out = np.full(len(sizes), np.nan)
    for width in np.unique(sizes[fits]):
        rows = np.flatnonzero(fits & (sizes == width))
        pick = pa.array(rows)
        with np.errstate(all="ignore"):
            out[rows] = kernel(matrix(a.take(pick), width), matrix(b.take(pick), width))
    return _nullable(out)


def against(kernel: Kernel, vectors: pa.Array, query: np.ndarray) -> np.ndarray:
    """``kernel`` of every row with one query; NaN where it is undefined."""
    sizes = lengths(vectors)
    rows = np.flatnonzero(sizes == len(query))
    block = vectors if len(rows) == len(sizes) else vectors.take(pa.array(rows))
    out = np.full(len(sizes), np.nan)
    with np.errstate(all="ignore"):
        out[rows] = kernel(matrix(block, len(query)), query[np.newaxis, :])
    return out


def dot_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, np.broadcast_to(y, x.shape))


def norm_kernel(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def cosine_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return dot_kernel(x, y) / (norm_kernel(x) * norm_kernel(y))


def l2_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return norm_kernel(x - y)


def minkowski_kernel(p: float) -> Kernel:
    """Scaled by the largest difference, so a large or small ``p`` stays finite."""

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        gaps = np.abs(x - y)
        top = gaps.max(axis=1)
        total = np.power(gaps / np.where(top == 0, 1.0, top)[:, None], p).sum(axis=1)
        return np.where(np.isnan(top), np.nan, np.power(total, 1.0 / p) * top)

    return kernel


# metric name -> (kernel factory taking p, is a larger value nearer)
METRICS: dict[str, tuple[Callable[[float], Kernel], bool]] = {
    "cosine": (lambda p: cosine_kernel, True),
    "dot": (lambda p: dot_kernel, True),
    "l2": (lambda p: l2_kernel, False),
    "minkowski": (minkowski_kernel, False),
}


def metric_kernel(metric: str, p: float = 2.0) -> tuple[Kernel, bool]:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
    if metric == "minkowski" and not p > 0:
        raise ValueError("minkowski needs p > 0")
    factory, larger_is_nearer = METRICS[metric]
    return factory(p), larger_is_nearer


def measure(a: Column, b: Column, metric: str, p: float = 2.0) -> Column:
    """Row-by-row measure of two vector columns."""
    kernel, _ = metric_kernel(metric, p)

    @F.arrow_udf("double")
    def pairwise(x: pa.Array, y: pa.Array) -> pa.Array:
        return rowwise(kernel, x, y)

    return pairwise(a, b)


def measure_to(vector: Column, query: list[float], metric: str, p: float = 2.0) -> Column:
    """Measure of a vector column with one fixed vector."""
    kernel, _ = metric_kernel(metric, p)
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return _nullable(against(kernel, x, target))

    return scored(vector)


def dot(a: Column, b: Column) -> Column:
    return measure(a, b, "dot")


def cosine(a: Column, b: Column) -> Column:
    return measure(a, b, "cosine")


def l2(a: Column, b: Column) -> Column:
    return measure(a, b, "l2")


def minkowski(a: Column, b: Column, p: float) -> Column:
    return measure(a, b, "minkowski", p)


def norm2(a: Column) -> Column:
    """Euclidean length; native, as one pass over one array is cheap."""
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )
