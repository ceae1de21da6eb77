"""PCA, truncated SVD and explained variance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.vectors import lengths, matrix
from codequarry.operators.rows import cumulative
from codequarry.operators.sampling import sample_frac
from codequarry.operators.sketch_svd import fit_svd_steps
from codequarry.session import durable

# Components kept for text, and for vectors before clustering
# and before plotting.
TEXT_COMPONENTS = 500
CLUSTER_COMPONENTS = 100
PLOT_COMPONENTS = 2

# Numbers that a product with sparse rows holds at a time.
GATHER_CELLS = 1 << 20


def fix_signs(components: np.ndarray) -> np.ndarray:
    """Turn each column so that its largest entry is positive."""
    peaks = np.abs(components).argmax(axis=0)
    signs = np.sign(components[peaks, np.arange(components.shape[1])])
    return components * np.where(signs == 0, 1.0, signs)


@dataclass
class PcaModel:
    """Centre (width d) and components (d × k), signs fixed by the largest loading."""

    mean: np.ndarray
    components: np.ndarray
    ratios: list[float]

    def transform(self, df: DataFrame, vec: str = "vec", out: str = "vec") -> DataFrame:
        """Centred scores in place of the vectors; a row of another width gives NULL."""
        return df.withColumn(out, project(F.col(vec), self.components, self.mean))


def project(vec: Column, components: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """``(vec - mean) · components``, one matrix product per Arrow batch."""
    width = components.shape[0]
    shift = np.zeros(width) if mean is None else mean

    @F.arrow_udf("array<double>")
    def scores(vectors: pa.Array) -> pa.Array:
        rows = np.flatnonzero(lengths(vectors) == width)
        block = matrix(vectors.take(pa.array(rows)), width) - shift
        flat = (block @ components).ravel()
        ends = np.zeros(len(vectors) + 1, dtype=np.int32)
        ends[rows + 1] = components.shape[1]
        null = np.ones(len(vectors), dtype=bool)
        null[rows] = False
        return pa.ListArray.from_arrays(
            pa.array(np.cumsum(ends), pa.int32()), pa.array(flat), mask=pa.array(null)
        )

    return scores(vec)


def fit_pca(
    df: DataFrame,
    k: int = CLUSTER_COMPONENTS,
    vec: str = "vec",
    frac: float | None = None,
    key: str = "id",
    seed: int = 42,
) -> PcaModel:
    """Fit on all rows, or on a ``frac`` share drawn by ``key``.

    The covariance is one aggregate over the rows (d × d numbers), so there is
    no difference between a whole and an incremental fit.
    """
    rows = df if frac is None else sample_frac(df, frac, key, seed)
    features = rows.where(F.col(vec).isNotNull()).select(array_to_vector(vec).alias("x"))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="x", outputCol="c").fit(features)
    fitted = PCA(k=k, inputCol="c", outputCol="p").fit(centre.transform(features))
    return PcaModel(
        centre.mean.toArray(),
        fix_signs(fitted.pc.toArray()),
        [float(r) for r in fitted.explainedVariance],
    )


def covariance(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, j, cov), d × d rows: the sample covariance the PCA starts from."""
    features = df.where(F.col(vec).isNotNull()).select(array_to_vector(vec).alias("x"))
    values = RowMatrix(MLUtils.convertVectorColumnsFromML(features, "x")).computeCovariance()
    width = values.numRows
    i, j = np.indices((width, width)).reshape(2, -1)
    table = pa.table({"i": i, "j": j, "cov": values.toArray().ravel()})
    return df.sparkSession.createDataFrame(table)


@dataclass
class SvdModel:
    """Right singular vectors (d × k), singular values, share of variance."""

    components: np.ndarray
    singular_values: np.ndarray
    ratios: list[float]


@dataclass
class SvdSteps:
    """Right singular vectors as a table (column, vec), singular values, share of variance."""

    table: DataFrame
    singular_values: np.ndarray
    ratios: list[float]

    @cached_property
    def components(self) -> np.ndarray:
        """The table as a matrix (d × k), for the driver of a narrow one."""
        rows = self.table.orderBy("column").select("vec").collect()
        return np.array([row.vec for row in rows]).reshape(len(rows), len(self.singular_values))


def project_sparse(features: Column, components: np.ndarray) -> Column:
    """``features · components`` for an ML vector column, sparse or dense."""
    k = components.shape[1]
    raw = F.unwrap_udt(features)

    @F.arrow_udf("array<double>")
    def scores(indices: pa.Array, values: pa.Array) -> pa.Array:
        weights = values.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(values.offsets.to_numpy())
        if indices.null_count:  # dense rows name no columns
            given = [np.arange(n) if x is None else x for x, n in zip(indices.to_pylist(), sizes)]
            columns = np.concatenate([np.zeros(0, np.int64), *given]).astype(np.int64)
        else:
            columns = indices.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(values), k))
        some = np.flatnonzero(sizes)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        step = max(1, GATHER_CELLS // max(k, 1))  # entries met at a time, whole rows
        while len(some):
            count = max(1, int(np.searchsorted(ends[some], starts[some[0]] + step, "right")))
            own, some = some[:count], some[count:]
            a, b = starts[own[0]], ends[own[-1]]
            cells = components[columns[a:b]]
            cells *= weights[a:b, None]
            out[own] = np.add.reduceat(cells, starts[own] - a, axis=0)
        ends = pa.array(np.arange(len(out) + 1) * k, pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    return scores(raw["indices"], raw["values"])


def fit_svd(
    df: DataFrame, k: int = TEXT_COMPONENTS, features: str = "features", solver: str = "gram"
) -> tuple[SvdModel, DataFrame]:
    """Truncated SVD of uncentred rows: (model, ``df`` with score column ``vec``).

    The ``gram`` solver sums the outer products in one pass and the driver
    solves a d × d problem, for up to some thousand columns. ``steps`` is for
    any number of columns: it multiplies a subspace until it stands, in blocks
    (see ``sketch_svd.fit_svd_steps``), and its model keeps the components as
    a table. Ratios are the variance of each score column over the total
    variance of the input columns. The features are written once and read by
    every pass.
    """
    if solver not in ("gram", "steps"):
        raise ValueError("solver must be gram or steps")
    if solver == "steps":
        return _fit_steps(df, k, features)
    df = durable(df)
    held = df.select(features)
    metrics = Summarizer.metrics("count", "mean", "variance").summary(F.col(features))
    seen = held.select(metrics.alias("s")).first().s
    rows = RowMatrix(MLUtils.convertVectorColumnsFromML(held, features))
    squares, vectors = np.linalg.eigh(rows.computeGramianMatrix().toArray())
    top = np.argsort(squares)[::-1][:k]
    singular, components = np.sqrt(np.maximum(squares[top], 0.0)), fix_signs(vectors[:, top])
    # A score column's sum of squares is its singular value squared, so its
    # variance needs no further pass.
    n = seen["count"]
    spread_of = singular**2 - n * (seen.mean.toArray() @ components) ** 2
    ratios = spread_of / max(n - 1, 1) / seen.variance.toArray().sum()
    scored = df.withColumn("vec", project_sparse(F.col(features), components)).drop(features)
    return SvdModel(components, singular, [float(r) for r in ratios]), scored


def _fit_steps(df: DataFrame, k: int, features: str) -> tuple[SvdSteps, DataFrame]:
    """The other columns travel with the rows as one, under names of their own."""
    kept = [c for c in df.columns if c not in (features, "vec")]
    names = [f"c{i}" for i in range(len(kept))]
    row = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(name) for c, name in zip(kept, names)])
    model, scored = fit_svd_steps(df.select(row.alias("row"), F.col(features)), k, features, "row")
    columns = [F.col(f"row.{name}").alias(c) for c, name in zip(kept, names)]
    return SvdSteps(model.components, model.singular_values, model.ratios), scored.select(*columns, "vec")


def variance_table(spark: SparkSession, ratios: list[float]) -> DataFrame:
    """(component, ratio, cumulative): one row per component."""
    rows = [(i + 1, float(r)) for i, r in enumerate(ratios)]
    table = spark.createDataFrame(rows, "component int, ratio double")
    return cumulative(table, ["component"], "ratio", "cumulative")
